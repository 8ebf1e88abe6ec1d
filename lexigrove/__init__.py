"""lexigrove: structured documents to a validated, queryable knowledge graph, on Spark DataFrames."""
