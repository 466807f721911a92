"""Every query of the library over the driver's tables."""

from eventloom.plans import conversions, detection, functions, manifest, storage  # noqa: F401
from eventloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
