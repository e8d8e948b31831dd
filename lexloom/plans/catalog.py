"""All catalogue queries."""
from lexloom.plans import (  # noqa: F401
    citation_catalog, conversation_catalog, document_catalog, evaluation_catalog, parts_catalog, query_catalog, search_catalog, stream_catalog, tree_catalog,
)
from lexloom.plans.common import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_rrf"
