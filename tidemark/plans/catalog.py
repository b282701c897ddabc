"""All registered queries."""

from tidemark.plans import (  # noqa: F401
    catalog_features,
    catalog_formulas,
    catalog_models,
    catalog_monitoring,
    catalog_tables,
)
from tidemark.plans.registry import CATALOG

__all__ = ["CATALOG"]
