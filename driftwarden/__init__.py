"""driftwarden: sensor-telemetry analytics and corpus preparation as PySpark DataFrame transforms."""
