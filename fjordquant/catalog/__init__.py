"""Named queries over the supplied tables, each with its check SQL."""

from fjordquant.catalog import (  # noqa: F401
    analysis, backtest, feeds, macro, market, news, prices, report, statements, streams, technical, vendor,
)
from fjordquant.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
