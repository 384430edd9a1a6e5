"""Map compilation on Spark: rasters, vector features and geotagged observations as DataFrames."""
