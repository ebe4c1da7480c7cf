"""All registered queries of the library."""

from clusterlake.plans import file_queries, run_queries  # noqa: F401
from clusterlake.plans.queries import QUERIES  # noqa: F401
