"""Evidence analytics and corpus processing as PySpark DataFrame operators."""
