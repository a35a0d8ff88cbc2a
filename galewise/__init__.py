"""Galewise: analytics on moving hazard areas and the routes planned around them, on Spark."""
