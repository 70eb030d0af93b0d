"""Column functions: integer codes and adjacency encodings."""
