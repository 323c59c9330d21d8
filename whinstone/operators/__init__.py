"""Operators over DataFrames: index, retrieval, fusion, evaluation, chunking, synchronisation, dataset compilation."""
