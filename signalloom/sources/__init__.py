"""Readers and payload normalizers that produce the signal tables."""
