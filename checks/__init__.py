"""SQL checks of the named queries."""
