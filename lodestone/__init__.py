"""lodestone: knowledge-graph construction, graph analytics and retrieval on PySpark DataFrames."""

__version__ = "0.1.0"
