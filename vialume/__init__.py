"""Graph, potential and corpus analytics expressed as Spark DataFrame plans."""
