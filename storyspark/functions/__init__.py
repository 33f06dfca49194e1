"""Package section."""
