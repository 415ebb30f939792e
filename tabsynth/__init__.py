"""tabsynth."""
