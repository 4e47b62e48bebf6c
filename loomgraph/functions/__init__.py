"""Column functions: all JVM-side, none of them a Python UDF."""
