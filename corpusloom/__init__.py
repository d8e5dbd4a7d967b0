"""corpusloom: a PySpark-native engine for building, matching and ranking an evidence corpus."""
