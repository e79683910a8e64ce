"""Readers, writers and model clients."""
