"""loomgraph: knowledge-graph analytics as PySpark DataFrames."""
