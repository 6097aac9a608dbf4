"""Example queries of every operator, with the SQL that checks them."""

from . import flows, quality, routing, stats, streams, synth, timeline  # noqa: F401 - importing registers the queries
from .base import ORACLES, QUERIES  # noqa: F401
