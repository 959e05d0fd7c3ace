"""Readers, fixed reference values, contracts, seeds and sinks."""
