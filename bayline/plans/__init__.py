"""Plans of the occupancy analytics library."""
