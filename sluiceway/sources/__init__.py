"""Where lines and records come from."""
