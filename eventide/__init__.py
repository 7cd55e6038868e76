"""Event studies on market time series, expressed as Spark DataFrame transformations."""
