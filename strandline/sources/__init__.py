"""sources of the strandline engine."""
