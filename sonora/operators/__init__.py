"""DataFrame -> DataFrame operators, each with explicit group keys."""
