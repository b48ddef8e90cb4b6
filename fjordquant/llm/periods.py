"""Runs of words that repeat with a short period, found on sparse diagonals.

Cell (i, q) says that word i equals word i - q; the cells of one lag q form a
diagonal, and a run of period q is a stretch of cells on it.  The dynamic program
keeps a match length for every active lag: an earlier occurrence of a word either
continues the diagonal of its lag or opens one, and a diagonal that ends is
emitted at once if its length is sufficient.

Which earlier occurrences open a cell keeps the diagonals sparse.  A run of length
4 q matches 3 q words on its diagonal, so for s / 2 < q <= s every cell that
matters starts a block of s matching words; and as a block of at least q words
occurs inside a run only at multiples of its smallest period, only the nearest
earlier occurrence of the block can have lag q.  Every word thus opens one cell a
scale s = 1, 2, 4, ... at most, and only where the half blocks both occur again:
n log n steps for n words, whatever they are, and no lag is left out.

Edge cases: null, empty and blank texts have no word and no run; texts of any
length are taken whole; rows that repeat are separate rows; an empty table gives an
empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import fresh

SHORTEST = 6   # words of a run at least
PERIODS = 4    # times the period at least
Places = Callable[[list[pa.Array], np.ndarray], np.ndarray]
RUN = "struct<start: long, length: long, period: long>"


def ranks(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, counted from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def nearest_earlier(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of every position in ``at`` to the one before it with the same rank, or 0."""
    order = np.argsort(rank, kind="stable")
    lag = np.zeros(len(at), np.int64)
    same = rank[order[1:]] == rank[order[:-1]]
    lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    return lag


def diagonals(at: np.ndarray, lag: np.ndarray, scale: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of diagonals that end with a sufficient length."""
    live = (lag > scale // 2) & (lag <= scale)
    at, lag = at[live], lag[live]
    if not len(at):
        return at, at, at
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    period = lag[first]
    start = at[first] - period
    length = at[last] + scale - start
    enough = length >= np.maximum(SHORTEST, PERIODS * period)
    return start[enough], length[enough], period[enough]


def runs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs of a batch; ``first`` cuts it into documents."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc] if n else first[:0]
    # the same word of another document is another word
    rank = ranks(S.mix(hashes + S.mix(doc.astype(np.uint64) + np.uint64(1))))
    at, scale, found = np.arange(n), 1, []
    while len(at):
        found.append(diagonals(at, nearest_earlier(rank, at), scale))
        # blocks of twice the length: both halves occur more than once, and fit
        seen = np.bincount(rank) > 1
        half = np.full(n + 1, -1, np.int64)
        half[at] = np.where(seen[rank], rank, -1)
        both = at[at + scale < n]
        least = np.maximum(SHORTEST, PERIODS * (scale + 1))
        both = both[(half[both] >= 0) & (half[both + scale] >= 0)]
        both = both[(both + 2 * scale <= end[both]) & ((end - first[:-1][doc])[both] >= least)]
        rank = ranks(half[both] * np.int64(n + 1) + half[both + scale])
        at, scale = both, 2 * scale
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (at, at, at)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) > 0


def joined(words: S.Words, keep: np.ndarray) -> list[str]:
    """The kept words of every document, joined by one space."""
    at = np.flatnonzero(keep)
    size = words.end[at] - words.start[at] + 1
    to = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    data = np.append(words.data, np.uint8(32))
    out = data[np.repeat(words.start[at] - to[:-1], size) + np.arange(to[-1])]
    out[to[1:] - 1] = 32
    cut = to[np.searchsorted(at, words.first)]
    raw = out.tobytes()
    return [raw[a:max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _scan(batches: Iterator[pa.RecordBatch], text: str, places: Places | None
          ) -> Iterator[pa.RecordBatch]:
    for batch in S.slices(batches, text):
        where = batch.schema.get_field_index(text)
        words = S.words(batch.column(where), S.separators(S.SPACE_BYTES), lower=False)
        hashes = words.hashes()
        others = [batch.column(i) for i in range(batch.num_columns) if i != where]
        if places is not None:
            at = places(others, words.first)
            hashes, words.start, words.end = hashes[at], words.start[at], words.end[at]
        n = len(hashes)
        start, length, period = runs_of(hashes, words.first)
        collapsed = joined(words, ~dropped(n, start, length, period))
        cut = np.searchsorted(start, words.first)
        own = start - np.repeat(words.first[:-1], np.diff(cut))
        runs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(own), pa.array(length), pa.array(period)], ["start", "length", "period"]))
        names = [name for i, name in enumerate(batch.schema.names) if i != where]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array(np.diff(words.first).astype(np.int64)), runs, pa.array(collapsed)],
            [*names, "n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, text: str, keep: list[str], places: Places | None = None
              ) -> DataFrame:
    """The columns ``keep`` and, for every row, n_words, runs and collapsed.

    ``runs`` are all stretches of consecutive words with smallest period q that are
    as long as max(6, 4 q) and that no neighbouring word extends, ordered by start
    and period.  ``collapsed`` is the text with the first period of each run only,
    words joined by one space.  ``places`` may put other words of a text into its
    places first: from the kept columns and the words' bounds it gives word numbers.
    """
    names = fresh(df, *[f"_keep{i}" for i in range(len(keep))], "_text")
    source = df.select(*[F.col(c).alias(x) for c, x in zip(keep, names)],
                       F.col(text).cast("string").alias(names[-1]))
    fields = [f"`{x}` {t}" for x, (_, t) in zip(names, source.dtypes[:-1])]
    done = source.mapInArrow(
        lambda batches: _scan(batches, names[-1], places),
        ", ".join([*fields, "n_words long", f"runs array<{RUN}>", "collapsed string"]))
    return done.select(*[F.col(x).alias(c) for c, x in zip(keep, names)],
                       "n_words", "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run of greatest length; of these that with the smallest start, then period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"),
                    (-best["period"]).alias("period"))


def planted(kept: list[pa.Array], first: np.ndarray) -> np.ndarray:
    """Word places whose tail repeats, for one document in ten; the others as they are.

    ``kept`` begins with the ids.  With h the crc32 of the decimal id, g = floor(h / 10)
    and n words, word i >= a = g mod n becomes word a + (i - a) mod p,
    p = 1 + floor((n - a) / (3 + g mod 8)).  A null id changes nothing.
    """
    out = np.arange(first[-1])
    for k, doc_id in enumerate(kept[0].to_pylist()):
        n = int(first[k + 1] - first[k])
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first[k] + a:first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return out
