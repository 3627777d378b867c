"""Column functions; all compose Spark's own expressions and stay in the JVM."""
