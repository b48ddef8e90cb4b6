"""Domain tables derived from the supplied star-schema tables."""
