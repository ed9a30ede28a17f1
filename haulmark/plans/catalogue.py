"""All registered queries."""

from haulmark.plans import (  # noqa: F401
    document_queries,
    question_queries,
    search_queries,
    service_queries,
    stream_queries,
    table_queries,
    underwriting_queries,
)
from haulmark.plans.registry import REGISTRY  # noqa: F401
