"""Manifest x manifest planning: creates, updates, deletes, metadata fixes."""
