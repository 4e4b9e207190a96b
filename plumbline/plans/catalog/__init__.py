"""The query catalog: one module per area, registered on import."""

from ..registry import ORACLE, QUERIES
from . import logs, metrics, quality, records, streaming, vision  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
