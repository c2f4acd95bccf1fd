"""Named queries over the given tables, each with its SQL where SQL can say it."""

from . import catalogs, cleaning, datetexts, features, panels, selection, series, sheets  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
