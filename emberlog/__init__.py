"""emberlog: incident-response analytics as PySpark DataFrame operators."""
