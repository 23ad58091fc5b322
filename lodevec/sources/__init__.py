"""Readers and writers: vector files, query text, stored indexes."""
