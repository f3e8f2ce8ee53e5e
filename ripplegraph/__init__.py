"""ripplegraph: economic-graph analytics expressed as Spark DataFrame jobs."""
