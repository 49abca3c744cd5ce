"""Sources and sinks: JSON lines, the point store, the graph store, the extraction cache."""
