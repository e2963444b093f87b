"""All registered queries."""

from gridmend.plans import catalog_cells, catalog_docs, catalog_flow, catalog_names, catalog_review  # noqa: F401
from gridmend.plans.registry import ORACLES, QUERIES  # noqa: F401
