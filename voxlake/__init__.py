"""Spark-first analytics over voxel, mesh and series tables."""
