"""The registered queries: views over the given tables, Spark queries and their SQL twins."""
