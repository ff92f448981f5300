"""DataFrame operators: ordered positions, grids, lookups, configuration merges, inventories, macro graphs."""
