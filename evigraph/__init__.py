"""Structure graphs, evidence checks and evaluation statistics as Spark DataFrame jobs."""
