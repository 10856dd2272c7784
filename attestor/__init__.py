"""Schema and data quality audits as Spark jobs."""
