"""graphtrust: a PySpark-native engine for trust-aware reference-graph analytics."""
