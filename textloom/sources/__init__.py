"""Readers and writers of corpora, pages and index snapshots."""
