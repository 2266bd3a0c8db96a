"""Readers and writers of corpora, manifests and reports."""
