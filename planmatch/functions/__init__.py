"""Column functions: text normalisation, label grammar, tolerant coercions, geometry of boxes and tiles."""
