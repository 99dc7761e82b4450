"""Imports every query module so that it registers itself."""

from catalog import answers, corpus, cost, evaluation, ranges, reduction, search, sources, streams, structure, targets  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
