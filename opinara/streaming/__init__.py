"""Questions that keep arriving, answered as a stream."""
