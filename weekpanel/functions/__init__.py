"""Column expressions: built-in Spark functions only, so every filter and projection stays in the JVM."""
