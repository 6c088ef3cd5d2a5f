"""revisio: evidence-synthesis analytics on Spark DataFrames."""
