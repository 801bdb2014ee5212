"""Column -> Column building blocks; nothing here leaves the JVM."""
