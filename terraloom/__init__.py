"""Gap filling, smoothing and calibration of raster time series as Spark DataFrame jobs."""
