"""Quality checks, features, profiles and forecasts for time series on Spark."""
