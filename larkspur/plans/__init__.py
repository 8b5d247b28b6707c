"""Registered plans over the driver tables."""
