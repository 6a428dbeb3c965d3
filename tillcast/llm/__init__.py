"""Operations of a training-data pipeline over documents and pages."""

from . import (  # noqa: F401  (each registers its query)
    bpe, decontaminate, fill_middle, html_text, jaccard, line_dedup, pii, quality, records, secret_scan, token_alignment, token_counts, toxicity,
)
from .checks import SQL
from .common import CHECKS, QUERIES

CHECKS.update(SQL)

__all__ = ["CHECKS", "QUERIES"]
