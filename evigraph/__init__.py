"""Evidence-graph analytics on Spark: DataFrame operators, functions, sources and streams."""
