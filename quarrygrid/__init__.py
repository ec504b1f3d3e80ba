"""A Spark-native engine for live pivots and analytics over keyed tables."""
