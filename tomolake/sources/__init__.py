"""Readers, writers and shared folders."""
