"""Column-level functions: every one takes and returns Spark Columns (JVM-side, no UDF)."""
