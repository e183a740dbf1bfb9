"""notaflow: fiscal document analytics as Spark DataFrames."""
