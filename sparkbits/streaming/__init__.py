"""Bit vectors over event streams."""
