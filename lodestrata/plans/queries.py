"""The registered queries of the panel engine and their SQL."""

from lodestrata.plans import extra, inventory, relational, research, rules, streams
from lodestrata.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "extra", "inventory", "relational", "research", "rules", "streams"]
