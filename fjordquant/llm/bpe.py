"""Byte-level BPE: pre-tokenisation by transition-function scans, cached merging.

The split pattern is a small automaton over character classes with one character
of look-ahead.  Every symbol stands for a function from state to state; the
functions that arise form a finite monoid, so a text is scanned in columns: each
block composes its symbols' functions by table look-ups, the blocks' results are
composed, and the true entry state of every block gives the boundaries.  The
slices between them are encoded with a bounded cache in front of the merges.

Edge cases: null and empty texts give no tokens and decode to nothing; texts of
any length are scanned whole; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import fresh

LETTER, NUMBER, OTHER, WHITE, SPACE, MARK2, MARK3, LONE, RESET = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, LEFT1, LEFT2 = range(8)
STATES = 8
CACHE_PIECES = 200_000
CACHE_BYTES = 48      # longer pieces are merged each time
BLOCK = 256


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token begin here)."""
    if symbol == RESET:
        return FRESH, True
    if state in (LEFT1, LEFT2):
        return (FRESH if state == LEFT1 else LEFT1), False
    if symbol in (LETTER, NUMBER, OTHER):
        target = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
        return target, state not in (target, AFTER_SPACE)
    if symbol in (MARK2, MARK3):  # an apostrophe that can open a contraction
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (LEFT1 if symbol == MARK2 else LEFT2), True
    if symbol == WHITE:           # white space before white space or the end
        return IN_WHITE, state != IN_WHITE
    if symbol == SPACE:           # a space before something else joins it
        return AFTER_SPACE, True
    return FRESH, True            # LONE: other white space before something else


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function ids of the symbols, composition table, images, boundary table)."""
    functions = [tuple(step(s, c)[0] for s in range(STATES)) for c in range(9)]
    known = {tuple(range(STATES)): 0}
    order = [tuple(range(STATES))]
    for f in functions:
        if f not in known:
            known[f] = len(order)
            order.append(f)
    i = 0
    while i < len(order):
        for f in functions:
            g = tuple(f[x] for x in order[i])
            if g not in known:
                known[g] = len(order)
                order.append(g)
        i += 1
    n = len(order)
    compose = np.zeros((n, n), np.uint16)
    for a, f in enumerate(order):
        for b, g in enumerate(order):
            compose[a, b] = known.setdefault(tuple(g[x] for x in f), 0)
    begins = np.array([[step(s, c)[1] for c in range(9)] for s in range(STATES)])
    return (np.array([known[f] for f in functions], np.uint16), compose,
            np.array(order, np.uint8), begins)


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    white = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
             *range(0x2000, 0x200B)}
    category = unicodedata.category
    for c in range(0x110000):
        kind = category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(white)] = WHITE
    return out


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Automaton symbols; ``last`` marks the end of each text."""
    kind = classes()[points]
    out = kind.copy()
    n = len(points)
    white = kind == WHITE
    followed = np.zeros(n, bool)
    followed[:-1] = ~white[1:]
    followed[last] = False
    alone = white & followed
    out[alone] = LONE
    out[alone & (points == 32)] = SPACE
    at = np.flatnonzero(points == 39)
    if len(at):
        left = np.searchsorted(last, at)
        room = last[left] - at
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        short = (room >= 1) & np.isin(one, [ord(c) for c in "stmd"])
        pairs = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pairs |= (one == ord(a)) & (two == ord(b))
        out[at[short]] = MARK2
        out[at[(room >= 2) & pairs]] = MARK3
    return out


def boundaries(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token begins at each character; texts begin at ``first``."""
    of_symbol, compose, image, begins = monoid()
    n = len(symbol)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // BLOCK)
    ids = np.zeros(blocks * BLOCK, np.uint16)
    ids[:n] = of_symbol[symbol]
    # a text's first character sees a fresh start whatever went before
    fresh_start = np.zeros(blocks * BLOCK, bool)
    fresh_start[first] = True
    reset = of_symbol[RESET]
    ids[first] = compose[reset, ids[first]]
    table = ids.reshape(blocks, BLOCK).T.copy()
    for k in range(1, BLOCK):  # prefixes inside all blocks at once
        table[k] = compose[table[k - 1], table[k]]
    entry = np.zeros(blocks, np.uint8)
    whole, state = table[-1], FRESH
    for b in range(blocks):
        entry[b] = state
        state = image[whole[b], state]
    before = np.empty((BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = image[table[:-1], entry[None, :]]
    states = before.T.reshape(-1)[:n].copy()
    states[first] = FRESH
    out = begins[states, symbol]
    out[first] = True
    return out


class Encoder(dict):
    """Piece -> token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        out = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a heap and a linked list."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or after[i] >= n or end[after[i]] != stop:
                continue  # one of the two parts has changed since
            gone = after[i]
            end[i], after[i] = stop, after[gone]
            end[gone] = -1
            if after[i] < n:
                before[after[i]] = i
                pair = piece[i:end[after[i]]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], i, end[after[i]]))
            if before[i] >= 0:
                pair = piece[before[i]:stop]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = after[i]
        return out


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes in id order, where each id's bytes begin)."""
    by_id = sorted((i, t) for t, i in ranks.items())
    at = np.zeros(by_id[-1][0] + 2, np.int64)
    for i, t in by_id:
        at[i + 1] = len(t)
    return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), np.cumsum(at)


def encode_slice(column: pa.Array, encoder: Encoder, sizes: np.ndarray
                 ) -> tuple[list[bytes], list[bytes]]:
    """Per text: token ids and the byte offsets where tokens end, both packed."""
    data, at = S.text_bytes(column)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of every character
    first_char = np.searchsorted(byte_of, at)
    full = first_char[1:] > first_char[:-1]
    begins = boundaries(symbols(points, first_char[1:][full] - 1), first_char[:-1][full]) \
        if len(points) else np.zeros(0, bool)
    cuts = byte_of[np.flatnonzero(begins)]
    first_cut = np.searchsorted(cuts, at).tolist()
    edges = np.append(cuts, len(raw)).tolist()
    ids, ends = [], []
    for a, b in zip(first_cut[:-1], first_cut[1:]):
        packed = b"".join([encoder[raw[edges[k]:edges[k + 1]]] for k in range(a, b)])
        ids.append(packed)
        ends.append(np.cumsum(sizes[np.frombuffer(packed, "<u4")]).astype("<u4").tobytes())
    return ids, ends


def decode_ids(packed: bytes, data: np.ndarray, at: np.ndarray) -> bytes:
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    if not len(ids):
        return b""
    size = at[ids + 1] - at[ids]
    stop = np.cumsum(size)
    return data[np.repeat(at[ids] - (stop - size), size) + np.arange(stop[-1])].tobytes()


def load_vocabulary(spark: SparkSession, path: str):
    """The rank file as a broadcast; its size is the vocabulary's, not the corpus's."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read().splitlines())


_LOADED: dict[int, tuple] = {}


def _tools(vocabulary) -> tuple:
    key = vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)
    if key not in _LOADED:
        ranks = read_ranks(vocabulary.value)
        data, at = token_bytes(ranks)
        _LOADED.clear()
        _LOADED[key] = (Encoder(ranks), data, at, np.diff(at))
    return _LOADED[key]


def encode(df: DataFrame, text: str, vocabulary, drop_text: bool = True) -> DataFrame:
    """Attach token_ids and token_ends (packed unsigned 32-bit integers).

    ``token_ends`` holds the byte offset in the text at which each token ends.
    """
    ids, ends, inner = fresh(df, "token_ids", "token_ends", "_encode")
    kept = [c for c in df.columns if not (drop_text and c == text)]
    source = df.select(*kept, F.col(text).alias(inner))
    schema = source.drop(inner).schema.add(ids, "binary").add(ends, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _, _, sizes = _tools(vocabulary)
        for batch in S.slices(batches, inner):
            packed, stops = encode_slice(batch.column(batch.num_columns - 1), encoder, sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(packed, pa.binary()), pa.array(stops, pa.binary())],
                [*batch.schema.names[:-1], ids, ends])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, vocabulary, name: str = "decoded") -> DataFrame:
    """Replace the packed ids column by the bytes it stands for."""
    kept = [c for c in df.columns if c not in (ids, name)]
    source = df.select(*kept, F.col(ids).alias("_ids"))
    schema = source.drop("_ids").schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, data, at, _ = _tools(vocabulary)
        for batch in batches:
            done = [decode_ids(x or b"", data, at)
                    for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(done, pa.binary())],
                [*batch.schema.names[:-1], name])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text."""
    coded = encode(docs.select(key, text), text, vocabulary).select(
        key, "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"))
    return decode(coded, "token_ids", vocabulary).select(
        key, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
