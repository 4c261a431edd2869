"""Inner equi-joins on Spark: strategies, workloads, plans and experiments."""
