"""Generated inputs and the timing-record CSV."""
