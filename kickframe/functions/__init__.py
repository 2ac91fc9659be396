"""Column-level building blocks: probabilities, score grids, seasons, names."""
