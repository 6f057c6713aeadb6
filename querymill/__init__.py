"""Query-understanding and click-analytics engine on Spark DataFrames."""
