"""Every operator over the given tables, with the SQL that must agree."""

from . import audits, datasets, histories, ledgers, replays
from .registry import QUERIES, oracles

__all__ = ["QUERIES", "audits", "datasets", "histories", "ledgers", "oracles", "replays"]
