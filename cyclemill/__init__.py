"""Machine-cycle telemetry analytics as Spark DataFrame plans."""
