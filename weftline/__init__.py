"""weftline: a PySpark-native engine for corpus building, token sequences and evaluation tables."""
