"""All queries on the domain's own operators; importing this registers them."""

from .plans import linking_queries, ranking_queries, relational_queries, routing_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
