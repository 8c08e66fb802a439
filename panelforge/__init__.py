"""panelforge: point-in-time panel analytics on Spark DataFrames."""
