"""plumbline: data quality, anomaly scoring and schema lineage as DataFrame operators on Spark."""
