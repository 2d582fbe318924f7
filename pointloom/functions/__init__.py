"""Column functions: calendar distances, projections, envelopes, circles and weights."""
