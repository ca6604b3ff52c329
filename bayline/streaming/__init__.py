"""Streaming of the occupancy analytics library."""
