"""All registered queries of the knowledge-graph part, with the SQL that checks them."""

from triplane.plans.queries import QUERIES
from triplane.plans.queries import SQL as ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
