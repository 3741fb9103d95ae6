"""Queries over the test tables: each operator bound to a role the tables can play."""

from . import agreement, effects, features, models, quality, sequences  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
from .models import flagship  # noqa: F401
