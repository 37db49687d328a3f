"""recollex: agent-memory analytics on Spark DataFrames."""
