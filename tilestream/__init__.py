"""tilestream: tiled rasters and the message streams that deliver them, as Spark DataFrames."""
