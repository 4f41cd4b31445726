"""Reading OTLP batches and writing fact tables."""
