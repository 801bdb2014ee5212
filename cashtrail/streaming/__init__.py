"""The batch operators run on streams."""
