"""Regatta: analytics over fleets of per-entity vectors, as PySpark DataFrame operators."""
