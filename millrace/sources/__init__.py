"""Readers and writers for record logs, manifests, score files and reports."""
