"""Incremental copies of the profile store."""
