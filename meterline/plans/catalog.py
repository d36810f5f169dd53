"""Imports every plan module, which registers its queries."""

from . import expressions, flows, ledgers, logs, reports, transcripts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
