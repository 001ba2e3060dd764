"""Running products over streams of entries."""
