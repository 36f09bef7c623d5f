"""All registered queries."""

from barline.catalog import fragments  # noqa: F401
from barline.catalog import core, evidence, inference, jobs, operations, quality, sources  # noqa: F401
from barline.catalog.registry import QUERIES, oracle

__all__ = ["QUERIES", "oracle"]
