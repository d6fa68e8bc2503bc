"""Windows and triggers on streams."""
