"""Part of the feature engine."""
