"""Registered queries over the driver tables, each with its oracle."""

from lectern.plans import extensions, quality, registry, search, structure, study, text, validation
from lectern.plans.base import CATALOG

__all__ = ["CATALOG", "extensions", "quality", "registry", "search", "structure", "study", "text", "validation"]
