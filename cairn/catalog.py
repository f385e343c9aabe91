"""All registered queries of the SQL side."""

from . import registry
from .operators import aggregation, joins, readers, selection  # noqa: F401
from .plans import by_sql, decision_support  # noqa: F401

by_sql.register()

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
