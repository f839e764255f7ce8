"""A Spark-first engine for gridded time series of weather and energy resources."""
