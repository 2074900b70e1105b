"""Weekly departures warehouse and forecaster, written as Spark DataFrame plans."""
