"""Readers, writers and snapshots."""
