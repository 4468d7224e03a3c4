"""Packaging cost and fit analytics as Spark DataFrame operations."""

from boxmetrics.tables import Staging, Tables
from boxmetrics.transforms import build_transform

__all__ = ["Staging", "Tables", "build_transform"]
