"""A Spark-first engine for canopy rasters, tree crowns and segmentation studies."""
