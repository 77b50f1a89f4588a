"""Topology of planar-contour volumes, as Spark DataFrame transformations."""
