"""strataflow: a Spark-first engine for time-indexed, stratified tables."""
