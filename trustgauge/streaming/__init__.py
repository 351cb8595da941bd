"""The row-local and additive operators over streams."""
