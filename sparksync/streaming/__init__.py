"""Change bursts and incremental sync."""
