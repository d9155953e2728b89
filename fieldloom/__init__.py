"""Spark jobs for simulation data: meshes, snapshots, samples and candidates as tables."""
