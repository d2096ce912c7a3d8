"""PySpark-native engine for evaluating answers and preferences at scale."""
