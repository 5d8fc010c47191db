"""Column builders: no shuffles, no actions, everything stays in the JVM."""
