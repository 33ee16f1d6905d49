"""DataFrame-to-DataFrame operators over token tables."""
