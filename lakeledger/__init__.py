"""lakeledger: lineage, schema history, load anomalies and job health as Spark jobs."""

__version__ = "0.1.0"
