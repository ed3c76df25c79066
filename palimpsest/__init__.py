"""A PySpark-native engine for finding, replacing and scoring personal data in text corpora."""
