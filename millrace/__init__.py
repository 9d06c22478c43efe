"""PySpark-native analytics for machine-learning data: criteria, features, vectors, preparation, ingestion."""
