"""Check queries of the library, each with SQL for a second engine where SQL can say it."""

from checks import analytics, intake, jobs, pricing, search, store, streams, urls  # noqa: F401
from checks.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
