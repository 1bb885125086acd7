"""Readers of manifests, recorder files and canonical tables."""
