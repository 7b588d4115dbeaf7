"""Frame series, as batches or streams."""
