"""tidewheel: time-series analysis workflows expressed as Spark DataFrame plans."""
