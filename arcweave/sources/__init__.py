"""Readers and writers of graphs and catalogs."""
