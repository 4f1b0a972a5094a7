"""Domain pipelines composed from the operators."""
