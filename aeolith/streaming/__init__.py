"""Statistics over streams of facts."""
