"""streaming of the strandline engine."""
