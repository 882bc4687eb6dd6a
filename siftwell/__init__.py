"""siftwell: a PySpark-native engine that filters, ranks and retrieves rows, and keeps their table current."""
