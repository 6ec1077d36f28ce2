"""Product recommendation and review analytics as lazy PySpark DataFrame operators."""
