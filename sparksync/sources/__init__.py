"""Manifests: inventories of file trees and of keyed tables."""
