"""Shared-folder storage: work folders, atomic manifests."""
