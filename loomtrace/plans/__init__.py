"""Queries by area. Importing the package registers them."""

from loomtrace.plans import banks, evaluation, ordered, records, relational, retrieval, rules, selection, shaping, views  # noqa: F401
from loomtrace.plans.registry import QUERIES, SQL  # noqa: F401
