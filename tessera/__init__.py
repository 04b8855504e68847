"""A Spark-first analytics engine: declarative operators over DataFrames."""
