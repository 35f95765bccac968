"""All queries of the library by name, with the SQL that gives the same rows."""

from . import areas, cleaning, derived, graphs, linking, overlays, profiles, ranks, reproduction, spatial, statistics, validation, variants  # noqa: F401
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
