"""Volumetric image analytics as Spark jobs."""
