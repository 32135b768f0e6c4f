"""plans of the strandline engine."""
