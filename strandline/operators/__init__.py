"""operators of the strandline engine."""
