"""Readers, sinks and bindings of tables to the engine's schemas."""
