"""Column-level functions: Unicode folding, tokens, information measures, scoring bands."""
