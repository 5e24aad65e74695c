"""streaming of kelpline."""
