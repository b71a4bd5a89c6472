"""Readers and writers for the file shapes a document collection comes in."""
