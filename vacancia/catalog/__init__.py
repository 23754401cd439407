"""Registered queries: every operator over the given tables, with the SQL that must agree."""
from .registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
