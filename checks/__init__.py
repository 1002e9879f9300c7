"""The operators bound to the driver tables, each with the SQL that says what has to come out."""

from . import (  # noqa: F401
    context_checks, emotion_checks, merge_checks, profile_checks, semantic_checks, style_checks, text_checks,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
