"""Session-archive analytics and training-data preparation on Apache Spark."""
