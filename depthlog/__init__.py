"""depthlog: depth-indexed well-log analytics as plain Spark DataFrames."""
