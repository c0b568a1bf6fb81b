"""Readers: manifests, result folders, images."""
