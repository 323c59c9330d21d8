"""Readers and writers of everything the engine exchanges with files."""
