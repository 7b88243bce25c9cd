"""Structured Streaming jobs. Each has a batch twin in ``operators.telemetry`` with the same semantics."""
