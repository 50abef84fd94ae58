"""Readers and writers of point, splat, camera and metadata files."""
