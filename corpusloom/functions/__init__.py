"""Column functions: JVM expressions, with Arrow-batched helpers only where Spark has none."""
