"""Equipment-telemetry analytics on Spark."""
