"""All named queries and their checks."""

from . import evaluation, features, models, panels  # noqa: F401  (each registers its queries)
from .base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
