"""marketlens: competitive-intelligence data work as Spark jobs."""
