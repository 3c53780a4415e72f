"""Queries over the driver's tables, one for each operator."""

from . import association, evaluation, grids, models, protocols, sampling, tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
