"""Column-valued functions: text, notes, hashing and small mathematics, all inside the JVM."""
