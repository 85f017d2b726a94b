"""Readers, uploads and inputs derived from the driver's tables."""
