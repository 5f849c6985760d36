"""Cohort analytics over PySpark DataFrames."""

from cohortwise.session import build_session, shared_dir
from cohortwise.sources.tables import Tables, load, project, warehouse

__all__ = ["Tables", "build_session", "load", "project", "shared_dir", "warehouse"]
