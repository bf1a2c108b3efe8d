"""All registered queries and their oracles."""

from . import (  # noqa: F401
    catalog_email,
    catalog_intel,
    catalog_kpi,
    catalog_logs,
    catalog_reports,
    catalog_streams,
)
from .lens import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
