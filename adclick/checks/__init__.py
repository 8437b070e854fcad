"""Registered queries and their SQL; importing the modules registers them."""

from adclick.checks import encoding, modelling, scalar, statistics  # noqa: F401
from adclick.checks.registry import QUERIES, SQL  # noqa: F401
