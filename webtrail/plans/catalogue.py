"""All registered queries."""

from webtrail.plans import (  # noqa: F401
    case_queries,
    file_queries,
    log_queries,
)
from webtrail.plans.registry import QUERIES  # noqa: F401
