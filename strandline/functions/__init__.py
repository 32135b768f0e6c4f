"""functions of the strandline engine."""
