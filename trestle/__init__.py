"""Rule validation and dependency-graph reasoning over tables, as Spark jobs."""
