"""Spark jobs over OpenTelemetry spans, logs and metrics."""
