"""DataFrame operators: extraction, lookup, graph, vector, search, history, pipeline."""
