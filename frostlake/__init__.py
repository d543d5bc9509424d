"""frostlake: refrigerated-shipment telemetry analytics on PySpark."""
