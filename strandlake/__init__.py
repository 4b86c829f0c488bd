"""Particle-assembly analytics and corpus operators as PySpark jobs."""
