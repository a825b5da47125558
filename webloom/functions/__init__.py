"""Column builders: URLs, text and vectors. All run in the JVM."""
