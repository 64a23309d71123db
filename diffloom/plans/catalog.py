"""All queries of the core library."""

from diffloom.plans import alert_queries, eval_queries, line_queries, rule_queries, stream_queries, table_queries  # noqa: F401, I001
from diffloom.plans import review_queries  # noqa: F401, I001  (uses the SQL of those above)
from diffloom.plans.registry import QUERIES, SQL  # noqa: F401
