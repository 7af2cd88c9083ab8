"""All registered queries of the regional operators, and their SQL."""

from landloom.plans import reports
from landloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "reports"]
