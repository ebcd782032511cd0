"""A PySpark-native engine for curating, evaluating and analysing conversational AI data."""
