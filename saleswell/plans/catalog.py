"""Imports every module that registers queries."""

from saleswell.plans import queries_channels, queries_feeds, queries_files, queries_ingest, queries_inventory, queries_kpi, queries_sku, queries_streaming  # noqa: F401
from saleswell.plans.registry import REGISTRY  # noqa: F401
