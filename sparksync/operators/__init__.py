"""Filters, signatures, deltas, tiers, reports, links and apply."""
