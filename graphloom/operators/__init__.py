"""Graph, ranking and text operators over DataFrames."""
