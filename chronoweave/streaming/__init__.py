"""Questions as a stream."""
