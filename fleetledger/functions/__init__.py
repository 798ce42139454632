"""Column expressions: text, dates, aggregates. All of them stay inside the JVM."""
