"""Graph-retrieval analytics and training-data operators as PySpark DataFrame plans."""
