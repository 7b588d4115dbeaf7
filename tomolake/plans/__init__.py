"""Composite analyses and registered queries."""
