"""Operators of the occupancy analytics library."""
