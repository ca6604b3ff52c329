"""Sources of the occupancy analytics library."""
