"""A PySpark-native analytics engine for ordered frame sequences and their benchmarks."""
