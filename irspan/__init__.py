"""Information-retrieval experiments and training-data preparation as Spark DataFrame plans."""
