"""Queries over the driver's tables and the profile pipeline."""
