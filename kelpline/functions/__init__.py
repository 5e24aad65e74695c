"""functions of kelpline."""
