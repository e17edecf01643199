"""lodestone: evidence graphs and graph analytics as PySpark plans."""
