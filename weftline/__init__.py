"""Knowledge-graph relation alignment as Spark DataFrame pipelines."""
