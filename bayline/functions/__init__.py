"""Functions of the occupancy analytics library."""
