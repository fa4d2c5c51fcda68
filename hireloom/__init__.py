"""hireloom: a PySpark-native engine for job-posting analytics."""
