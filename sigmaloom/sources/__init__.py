"""Readers, writers and dataset descriptors."""
