"""Readers and writers of record and truth tables."""
