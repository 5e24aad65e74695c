"""sources of kelpline."""
