"""Technical state of chosen bars from arrays, a few symbols at a time.

Window frames cost some 70 microseconds a bar, most of it for lists that only the
chosen bars need.  Here the bars come sorted by symbol and time; whole symbols are
taken together, every recursion and frame is worked out on flat arrays, and only
the chosen bars leave.  A symbol's bars are bounded by the calendar, and no more
than a batch and one symbol is held.  A null is a NaN inside the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.smoothing import block_length
from fjordquant.session import spread

PRICES = ["open", "high", "low", "close", "volume"]
CROSSES = ["macd", "tk", "base"]
ZONES = np.array([None, "tren_may", "duoi_may", "trong_may"], dtype=object)
DOUBLES = [*PRICES, "prev", "tr", "gain", "loss", "ema12", "ema26", "atr", "avg_gain", "avg_loss",
           "macd", "signal", "hist", "rsi", "tenkan", "kijun", "base_b", "chikou", "base_a",
           "senkou_a", "senkou_b", "_back", "_avg_volume", "hist_slope", "rsi_slope", "upper",
           "lower", "divergence_strength"]
INTS = ["i", *[f"{c}_{k}" for c in CROSSES for k in ("cross_at", "bars")], "_started", "_seen"]
STRINGS = ["zone", *[f"{c}_cross" for c in CROSSES], "divergence"]


def _lag(v: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(v), np.nan)
    if len(v) > n:
        out[n:] = v[:-n]
    out[i < n] = np.nan
    return out


def _frames(v: np.ndarray, i: np.ndarray, n: int, of: Callable) -> np.ndarray:
    """``of`` the last n values of each row, NaN unless all n are there."""
    out = np.full(len(v), np.nan)
    if len(v) >= n:
        out[n - 1:] = of(np.lib.stride_tricks.sliding_window_view(v, n))
    out[i < n - 1] = np.nan
    return out


def _ewm(v: np.ndarray, starts: np.ndarray, i: np.ndarray, alpha: float, start: int, least: int
         ) -> np.ndarray:
    """The sums of ``functions.smoothing``, block by block."""
    block, decay = block_length(alpha), 1.0 - alpha
    inner = i % block
    weight = np.where(i == start, 1.0, alpha)
    with np.errstate(over="ignore"):
        term = np.where(i >= start, v * weight * np.power(decay, -inner.astype(float)), 0.0)
    known = ~np.isnan(term)
    term = np.where(known, term, 0.0)
    sums, before, seen = np.empty(len(v)), np.zeros(len(v)), np.empty(len(v), dtype=bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        last = 0.0
        for x in range(a, b, block):
            y = min(x + block, b)
            sums[x:y] = np.cumsum(term[x:y])
            seen[x:y] = np.logical_or.accumulate(known[x:y])
            before[x:y] = last
            last = sums[y - 1]
    out = np.power(decay, inner.astype(float)) * sums + np.power(decay, inner + float(block)) * before
    out = np.where(i == start, v, np.where(seen, out, np.nan))
    return np.where(i >= start + least - 1, out, np.nan)


def _latest(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row number of the latest hit up to each row of its symbol, -1 without one."""
    at = np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1))
    return np.where(at >= first, at, -1)


def _swings(v: np.ndarray, i: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the swing highs and lows of ``v``."""
    n, width = len(v), 2 * order + 1
    if n < width:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    w = np.lib.stride_tricks.sliding_window_view(v, width)
    mid, rows = v[order:n - order], np.arange(order, n - order)
    # all rows of the window belong to one symbol and have a value
    ok = (i[rows + order] - i[rows] == order) & (i[rows] >= order) & ~np.isnan(w).any(axis=1)
    high = ok & (mid >= w.max(axis=1)) & (mid > w[:, :order].max(axis=1))
    low = ok & ~high & (mid <= w.min(axis=1)) & (mid < w[:, :order].min(axis=1))
    return rows[high], rows[low]


def _pair(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last two of ``rows`` inside [lo, hi], and whether there are two."""
    a, b = np.searchsorted(rows, lo, "left"), np.searchsorted(rows, hi, "right")
    two = b - a >= 2
    pick = rows if len(rows) else np.zeros(1, dtype=int)
    return pick[np.where(two, b - 2, 0)], pick[np.where(two, b - 1, 0)], two


def _nearest(rows: np.ndarray, v: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray,
             tolerance: int) -> np.ndarray:
    """Value at the row inside [lo, hi] closest to ``at``, the earlier one on a tie."""
    if not len(rows):
        return np.full(len(at), np.nan)
    a, b = np.searchsorted(rows, lo, "left"), np.searchsorted(rows, hi, "right")
    k = np.searchsorted(rows, at, "left")
    left, right = np.clip(k - 1, 0, len(rows) - 1), np.clip(k, 0, len(rows) - 1)
    far = np.iinfo(np.int64).max
    d_left = np.where((k - 1 >= a) & (k - 1 < b), at - rows[left], far)
    d_right = np.where((k >= a) & (k < b), rows[right] - at, far)
    best = np.where(d_left <= d_right, rows[left], rows[right])
    return np.where(np.minimum(d_left, d_right) <= tolerance, v[best], np.nan)


def _divergence(c: dict, rows: np.ndarray, lookback: int = 60, order: int = 5
                ) -> tuple[np.ndarray, np.ndarray]:
    close, osc, i = c["close"], c["hist"], c["i"]
    ph, pl = _swings(close, i, order)
    oh, ol = _swings(osc, i, order)
    lo, hi = np.maximum(rows - (lookback - 1 - order), rows - i[rows]), rows - order

    def gap(price, points):
        first, second, two = _pair(price, lo, hi)
        a, b = (_nearest(points, osc, x, lo, hi, 2 * order) for x in (first, second))
        return close[first], close[second], np.where(two, a, np.nan), np.where(two, b, np.nan)

    v1, v2, a, b = gap(pl, ol)
    w1, w2, x, y = gap(ph, oh)
    bullish, bearish = (v2 < v1) & (b > a), (w2 > w1) & (y < x)

    def strength(first, second):
        return np.abs(second - first) / np.where(first == 0, 1.0, np.abs(first))

    kind = np.full(len(rows), None, dtype=object)
    kind[bearish], kind[bullish] = "bearish", "bullish"
    return kind, np.where(bullish, strength(a, b), np.where(bearish, strength(x, y), 0.0))


def _bands(c: dict, rows: np.ndarray, lookback: int = 252) -> tuple[np.ndarray, np.ndarray]:
    """90th and 10th percentile of the last RSI values, held inside fixed limits."""
    held = np.concatenate([np.full(lookback, np.nan), c["rsi"]])
    win = np.lib.stride_tricks.sliding_window_view(held, lookback)[rows + 1].copy()
    # rows of the symbol before are none of this symbol's
    win[np.arange(lookback)[None, :] < (lookback - 1 - c["i"][rows])[:, None]] = np.nan
    win.sort(axis=1)
    n = (~np.isnan(win)).sum(axis=1)
    r = np.arange(len(rows))

    def at(p, limits):
        pos = np.maximum(n - 1, 0) * p
        lo, hi = np.floor(pos).astype(int), np.ceil(pos).astype(int)
        a, b = win[r, lo], win[r, hi]
        return np.where(n >= min(60, lookback), np.clip(a + (b - a) * (pos - lo), *limits), np.nan)

    return at(0.9, S.RSI_UPPER), at(0.1, S.RSI_LOWER)


def states(c: dict, starts: np.ndarray, rows: np.ndarray, spans: tuple[int, int, int], shift: int
           ) -> dict:
    """The state columns of ``rows``; ``c`` holds the prices of whole symbols by time and
    ``starts`` their first rows, with the number of rows at the end."""
    lengths = np.diff(starts)
    first = np.repeat(starts[:-1], lengths)
    i = np.arange(len(first)) - first
    c = {k: c[k] for k in PRICES} | {"i": i}
    close, high, low = c["close"], c["high"], c["low"]
    c["prev"] = prev = _lag(close, i, 1)
    c["tr"] = np.fmax(np.fmax(high - low, np.abs(high - prev)), np.abs(low - prev))
    delta = close - prev
    c["gain"], c["loss"] = np.maximum(delta, 0.0), np.maximum(-delta, 0.0)
    for name, value, alpha, start, least in (
            ("ema12", "close", 2 / 13, 0, 12), ("ema26", "close", 2 / 27, 0, 26),
            ("atr", "tr", 1 / 14, 0, 14), ("avg_gain", "gain", 1 / 14, 1, 14),
            ("avg_loss", "loss", 1 / 14, 1, 14)):
        c[name] = _ewm(c[value], starts, i, alpha, start, least)
    c["macd"] = c["ema12"] - c["ema26"]
    c["signal"] = _ewm(c["macd"], starts, i, 2 / 10, 25, 1)
    c["hist"] = c["macd"] - c["signal"]
    loss = c["avg_loss"]
    ratio = c["avg_gain"] / np.where(loss == 0, np.nan, loss)
    c["rsi"] = np.where(np.isnan(loss), np.nan, np.where(
        np.isnan(ratio), 100.0, 100 - 100 / (1 + ratio)))
    for name, n in zip(("tenkan", "kijun", "base_b"), spans, strict=True):
        top = _frames(high, i, n, lambda w: w.max(axis=1))
        # a missing low is passed over, a missing high is not
        bottom = _frames(np.where(np.isnan(low), np.inf, low), i, n, lambda w: w.min(axis=1))
        c[name] = (top + np.where(np.isinf(bottom), np.nan, bottom)) / 2
    c["chikou"] = np.full(len(i), np.nan)
    if len(i) > shift:
        c["chikou"][:-shift] = np.where(i[shift:] >= shift, close[shift:], np.nan)
    c["base_a"] = (c["tenkan"] + c["kijun"]) / 2
    a, b = (_lag(c[k], i, shift) for k in ("base_a", "base_b"))
    c["senkou_a"], c["senkou_b"] = a, b
    for name, fast, slow in (("macd", "macd", "signal"), ("tk", "tenkan", "kijun"),
                             ("base", "base_a", "base_b")):
        sign = np.sign(c[fast] - c[slow])
        before = _lag(sign, i, 1)
        at = _latest(~np.isnan(sign) & ~np.isnan(before) & (sign != before), first)[rows]
        c[f"{name}_cross"] = np.where(at < 0, None, np.where(sign[at] > 0, "golden", "death"))
        c[f"{name}_cross_at"] = np.where(at < 0, -1, i[at])
        c[f"{name}_bars"] = np.where(at < 0, -1, i[rows] - i[at])
    known = ~(np.isnan(close) | np.isnan(a) | np.isnan(b))
    zone = np.where(known, np.where(close > np.maximum(a, b), 1, np.where(
        close < np.minimum(a, b), 2, 3)), 0)
    begun = _latest((zone > 0) & (zone != np.where(i > 0, np.roll(zone, 1), 0)), first)
    c["_started"] = np.where(begun < 0, -1, i[begun])
    count = np.cumsum(zone > 0)
    c["_seen"] = count - (count[first] - (zone[first] > 0))
    c["zone"] = ZONES[zone]
    c["_back"] = _lag(close, i, shift)
    c["_avg_volume"] = _frames(c["volume"], i, 20, lambda w: w.sum(axis=1) / 20)
    c["hist_slope"] = _frames(c["hist"], i, 3, lambda w: (w[:, 2] - w[:, 0]) / 2)
    c["rsi_slope"] = _frames(c["rsi"], i, 5, lambda w: (
        2 * (w[:, 4] - w[:, 0]) + (w[:, 3] - w[:, 1])) / 10)
    upper, lower = _bands(c, rows)
    kind, strength = _divergence(c, rows)
    ready = {"upper": upper, "lower": lower, "divergence": kind, "divergence_strength": strength}
    ready |= {f"{x}_{k}": c[f"{x}_{k}"] for x in CROSSES for k in ("cross", "cross_at", "bars")}
    return ready | {k: v[rows] for k, v in c.items() if k not in ready}


def _chunk(table: pa.Table, whole: bool, spans: tuple[int, int, int], shift: int
           ) -> tuple[pa.Table, pa.RecordBatch | None]:
    """What is left of ``table`` (its last symbol, unless ``whole``), and the chosen bars."""
    n = table.num_rows
    symbol = table.column("symbol").combine_chunks()
    turn = np.flatnonzero(pc.not_equal(symbol[1:], symbol[:-1]).to_numpy(
        zero_copy_only=False)) + 1
    end = n if whole else (int(turn[-1]) if len(turn) else 0)
    if not end:
        return table, None
    done, rest = table.slice(0, end).combine_chunks(), table.slice(end)
    mark = done.column("_mark").to_numpy()
    day = done.column("time").cast(pa.int32()).fill_null(np.iinfo(np.int32).min).to_numpy()
    bar = np.flatnonzero(~mark)
    if not len(bar):
        return rest, None
    new = np.zeros(end + 1, dtype=bool)
    new[[0, end, *turn[turn < end]]] = True
    part = np.cumsum(new[:-1])
    # a mark stands behind the bar of its day
    back = np.cumsum(~mark) - 1
    m = np.flatnonzero(mark & (back >= 0))
    own = bar[back[m]]
    rows = np.unique(back[m][(part[own] == part[m]) & (day[own] == day[m])])
    if not len(rows):
        return rest, None
    starts = np.append(np.flatnonzero(np.diff(part[bar], prepend=-1)), len(bar))
    got = states({k: done.column(k).to_numpy(zero_copy_only=False)[bar] for k in PRICES},
                 starts, rows, spans, shift)
    keep = pa.array(bar[rows])
    columns = [done.column(k).combine_chunks().take(keep) for k in ("symbol", "time")]
    columns += [pa.array(got[k], pa.float64(), from_pandas=True) for k in DOUBLES]
    columns += [pa.array(got[k], pa.int32(), mask=got[k] < 0) for k in INTS]
    columns += [pa.array(got[k], pa.string()) for k in STRINGS]
    return rest, pa.RecordBatch.from_arrays(
        columns, names=["symbol", "time", *DOUBLES, *INTS, *STRINGS])


def states_at(bars: DataFrame, wanted: DataFrame, preset: str, shift: int) -> DataFrame:
    """The state columns at the bars of ``wanted`` (symbol, time); one exchange by symbol."""
    spans = S.ICHIMOKU_PRESETS[preset]
    prices = bars.select("symbol", "time", *[F.col(c).cast("double") for c in PRICES],
                         F.lit(False).alias("_mark"))
    marks = wanted.where(F.col("time").isNotNull()).select("symbol", "time", *[F.lit(None).cast("double").alias(c) for c in PRICES],
                          F.lit(True).alias("_mark"))
    # a bar without a symbol is chosen by none
    both = spread(prices.unionByName(marks).where(F.col("symbol").isNotNull()), "symbol"
                  ).sortWithinPartitions("symbol", "time", "_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, parts = None, []
        with np.errstate(invalid="ignore", divide="ignore"):
            for batch in batches:
                parts.append(batch)
                if sum(p.num_rows for p in parts) < 8000:
                    continue
                table = pa.Table.from_batches(parts)
                left, out = _chunk(pa.concat_tables([left, table]) if left else table, False,
                                   spans, shift)
                parts = []
                if out is not None:
                    yield out
            table = pa.Table.from_batches(parts) if parts else None
            rest = [t for t in (left, table) if t is not None and t.num_rows]
            if rest:
                out = _chunk(pa.concat_tables(rest), True, spans, shift)[1]
                if out is not None:
                    yield out

    symbol = bars.schema["symbol"].dataType.simpleString()
    schema = ", ".join([f"symbol {symbol}", "time date", *[f"{c} double" for c in DOUBLES],
                        *[f"{c} int" for c in INTS], *[f"{c} string" for c in STRINGS]])
    return both.mapInArrow(run, schema)
