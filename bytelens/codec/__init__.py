"""codec."""
