"""Column functions; all run inside Spark's own expressions unless their docstring says otherwise."""
