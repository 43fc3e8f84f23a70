"""Pattern tables."""
