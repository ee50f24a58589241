"""Transaction monitoring as PySpark DataFrame, Structured Streaming and pyspark.ml jobs."""
