"""Functions of grids: keys, statistics, resampling, noise, numbers, colours, JSON."""
