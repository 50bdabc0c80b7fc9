"""Column functions. What Spark's own functions can express stays in the JVM."""
