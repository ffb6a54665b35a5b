"""Readers, adapter views and sinks."""
