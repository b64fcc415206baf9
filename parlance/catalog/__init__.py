"""Registered queries; importing the package fills ``registry.QUERIES`` and ``registry.ORACLE``."""

from parlance.catalog import (  # noqa: F401
    block_queries,
    conversation_queries,
    flow_queries,
    manifest_queries,
    signal_queries,
    source_queries,
    transcript_queries,
)
from parlance.catalog.registry import ORACLE, QUERIES  # noqa: F401
