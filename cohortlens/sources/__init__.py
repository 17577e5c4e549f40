"""Readers, sinks and the deterministic domain views."""
