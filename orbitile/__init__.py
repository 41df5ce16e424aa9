"""Orbitile: geospatial tile analytics as Spark DataFrame operators."""
