"""Column-expression builders (JVM-side ``pyspark.sql.functions`` only)."""
