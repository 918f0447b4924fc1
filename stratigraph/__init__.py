"""stratigraph: a Spark-first analytics engine for code and text corpora."""
