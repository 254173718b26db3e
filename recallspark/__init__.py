"""recallspark: a PySpark-native engine for agent memory, evidence retrieval and its evaluation."""

__version__ = "0.1.0"
