"""webloom: a Spark-native engine for web-document analytics and ranked search."""
