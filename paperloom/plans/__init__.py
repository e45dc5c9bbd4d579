"""Session set-up and scale-safe building blocks."""
