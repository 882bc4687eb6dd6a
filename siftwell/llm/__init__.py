"""Training-data operators.  Nothing else in ``siftwell`` imports this subpackage."""
