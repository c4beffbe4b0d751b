"""Code-health analytics as Spark queries."""
