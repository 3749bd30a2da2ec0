"""Plans: stand-in graph/function/history tables derived from the driver tables,
and the registered queries with their SQL oracles."""
