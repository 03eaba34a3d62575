"""All named queries: importing a plan module registers its queries."""

from recordaudit.plans import audit, composition, matching, names, rules, sources, spectra, structures  # noqa: F401
from recordaudit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
