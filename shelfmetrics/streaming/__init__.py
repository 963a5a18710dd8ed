"""The same columns over streams."""
