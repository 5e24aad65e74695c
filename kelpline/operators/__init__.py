"""operators of kelpline."""
