"""wordloom: corpus analytics as Spark DataFrame plans."""
