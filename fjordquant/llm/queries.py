"""All queries of the subpackage; importing this module registers them."""

from fjordquant.llm import queries_free, queries_native, queries_round3  # noqa: F401
from fjordquant.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
