"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

A word one edit away from another shares its first or its last half with it.  So
there are two searches: the one half is matched exactly, then the match is extended
across the other half, where one code point may be inserted, deleted or replaced.
Each search runs on the FM-index that extends in its direction (of the words, or of
the reversed words): a state is an interval of suffix ranks of the delimited
vocabulary, and one step narrows all states by one character with two rank lookups.
Every pair is found once: by the first search if the first half is shared, else by
the second.

The vocabulary is never in one place.  Words that can meet share an exact half, so
every word is sent to the buckets of its possible halves (two lengths a side) and an
index is built for each bucket of about WORDS rows.  A half that more than WORDS
words share is cut into blocks by word, and its patterns go to all blocks.

Edge cases: null and empty texts hold no word; rows without an id keep their runs as
they are; repeated rows count each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import Scratch

SHORTEST, RAREST = 5, 3   # code points and occurrences of a word, at least
DROPPED = 97              # one run in so many loses a code point
RATIO = 2                 # a form occurs so many times as often, at least
WORDS = 1 << 15           # rows of a bucket, and words of a block
COUNTED_BYTES = 4 << 20   # text whose words are counted together
END, NONE = 0, 1          # delimiter, and what precedes the first one; no letter codes

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
PAIRS = "word string, n long, near string, near_n long"


# ---- counting

def letter_runs(column: pa.Array) -> S.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (lead byte C3), A-Z in lower case."""
    data, at = S.text_bytes(column)
    lead = data == 0xC3
    inside = ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[inside[cut] & inside[cut - 1]]
    starts[joined] = True
    ends[joined - 1] = True
    start = np.flatnonzero(starts)
    return S.Words(S.LOWER[data], start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def count_words(ids: list, column: pa.Array) -> Counter:
    """Counts of the words of some texts; of one (id, run) in 97 the words lack a code point."""
    words = letter_runs(column)
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    long = points[words.end] - points[words.start] >= SHORTEST
    doc = np.repeat(np.arange(len(ids)), np.diff(words.first))[long]
    hashes = words.hashes()[long]
    start, end = words.start[long], words.end[long]
    _, at, times = np.unique(S.mix(hashes + S.mix(doc.astype(np.uint64))),
                             return_index=True, return_counts=True)
    raw = words.data.tobytes()
    seed = [0 if i is None else zlib.crc32(b"%d:" % i) for i in ids]
    doc, start, end, hashes = doc[at], start[at], end[at], hashes[at]
    h = np.array([zlib.crc32(raw[a:b], seed[d])
                  for a, b, d in zip(start.tolist(), end.tolist(), doc.tolist())], np.int64)
    hit = (h % DROPPED == 0) & np.array([i is not None for i in ids], bool)[doc]
    out: Counter = Counter()
    for k in np.flatnonzero(hit).tolist():
        word = raw[start[k]:end[k]].decode()
        place = int(h[k]) % len(word)
        word = word[:place] + word[place + 1:]
        if len(word) >= SHORTEST:
            out[word] += int(times[k])
    rest = np.flatnonzero(~hit)
    _, one, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
    total = np.bincount(which, times[rest]).astype(np.int64)
    for k, n in zip(rest[one].tolist(), total.tolist()):
        out[raw[start[k]:end[k]].decode()] += n
    return out


def vocabulary(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(word, n): words of at least SHORTEST code points that occur RAREST times overall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text", COUNTED_BYTES):
            counts = count_words(batch.column(0).to_pylist(), batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["word", "n"])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= RAREST)


# ---- index and search

def build(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters before the ranked suffixes, their sorted (character, rank) keys).

    The text is every word between delimiters; ``words`` are sorted, so delimiter k has
    rank k and word k follows it.
    """
    text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    n, ends = len(text), text == END
    rank = np.where(ends, np.cumsum(ends) - 1, len(words) + 1 + text)
    step = 1
    while True:  # prefix doubling
        after = np.zeros(n, np.int64)
        after[:-step or None] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 400) + after, return_inverse=True)[1].astype(np.int64)
        if rank.max() == n - 1:
            break
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = text[order - 1]
    before[order == 0] = NONE
    return before, np.sort(before * (n + 1) + np.arange(n))


def narrow(keys: np.ndarray, char: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Intervals of the matches with one more character in front."""
    base = char * np.int64(len(keys) + 1)
    return np.searchsorted(keys, base + lo), np.searchsorted(keys, base + hi)


def children(before: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(which interval, character, lo, hi) of all one-letter extensions of some intervals."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    rows = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    char = before[rows]
    letter = (char != END) & (char != NONE)
    pair = np.unique(which[letter] * 256 + char[letter])
    which, char = pair // 256, pair % 256
    return which, char, *narrow(keys, char, lo[which], hi[which])


def one_edit(words: list[bytes], patterns: list[bytes], exact: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) numbers of words that end as the pattern does (its last ``exact``
    characters) and differ from it by one edit before that; each once."""
    before, keys = build(words)
    flat = np.frombuffer(b"".join(patterns) or b"\0", np.uint8).astype(np.int64)
    last = np.cumsum([len(p) for p in patterns]) - 1
    length = np.array([len(p) for p in patterns], np.int64)
    at = lambda q, depth: flat[last[q] - depth]
    q = np.arange(len(patterns))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(words) + 1)
    none = np.zeros(0, np.int64)
    wrong, found = (none, none, none), []
    for depth in range(int(length.max(initial=0)) + 1):
        more = [wrong]
        later = []
        ready = np.flatnonzero(depth >= exact[q])
        if len(ready):
            r, rlo, rhi = q[ready], lo[ready], hi[ready]
            _, one, group = np.unique(rlo * np.int64(len(keys) + 1) + rhi,
                                      return_index=True, return_inverse=True)
            parent, char, clo, chi = children(before, keys, rlo[one], rhi[one])
            first = np.searchsorted(parent, np.arange(len(one) + 1))
            size = np.diff(first)[group]
            own = np.repeat(np.arange(len(r)), size)
            child = np.arange(size.sum()) + np.repeat(
                first[group] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            rest = length[r] > depth
            here = np.where(rest, at(r, np.minimum(depth, length[r] - 1)), END)
            other = char[child] != here[own]
            own, child = own[other], child[other]
            more.append((r[own], clo[child], chi[child]))  # inserted
            swap = rest[own]
            later.append((r[own[swap]], clo[child[swap]], chi[child[swap]]))  # replaced
            following = np.where(length[r] > depth + 1, at(r, np.minimum(depth + 1, length[r] - 1)), END)
            gone = rest & (following != here)
            later.append((r[gone], rlo[gone], rhi[gone]))  # deleted
        w, wlo, whi = (np.concatenate(x) for x in zip(*more))
        done = length[w] == depth
        dlo, dhi = narrow(keys, np.full(done.sum(), END), wlo[done], whi[done])
        found.append((w[done][dhi > dlo], dlo[dhi > dlo]))
        w, wlo, whi = w[~done], wlo[~done], whi[~done]
        wlo, whi = narrow(keys, at(w, depth), wlo, whi)
        later.append((w[whi > wlo], wlo[whi > wlo], whi[whi > wlo]))
        wrong = tuple(np.concatenate(x) for x in zip(*later))
        go = length[q] > depth
        q, lo, hi = q[go], lo[go], hi[go]
        lo, hi = narrow(keys, at(q, depth), lo, hi)
        q, lo, hi = q[hi > lo], lo[hi > lo], hi[hi > lo]
    return tuple(np.concatenate(x) for x in zip(*found))


def search(rows: pa.Table) -> pa.Table:
    """Pairs of one bucket's (front, word, n, stored, pattern) rows."""
    out: list[list] = [[], [], [], []]
    everything = list(zip(*(rows.column(c).to_pylist()
                            for c in ("front", "word", "n", "stored", "pattern"))))
    for front in (True, False):
        turn = (lambda b: b[::-1]) if front else (lambda b: b)
        mine = [(turn(w.encode("latin-1")), w, n, s, p) for f, w, n, s, p in everything if f == front]
        stored = sorted({(b, w, n) for b, w, n, s, _ in mine if s})
        asked = sorted({(b, w, n) for b, w, n, _, p in mine if p})
        if not stored or not asked:
            continue
        exact = np.array([len(b) // 2 if front else len(b) - len(b) // 2 for b, _, _ in asked])
        a, b = one_edit([x[0] for x in stored], [x[0] for x in asked], exact)
        for i, j in zip(a.tolist(), b.tolist()):
            (_, word, n), (_, near, near_n) = asked[i], stored[j]
            half = len(word) // 2
            if front or word[:half] != near[:half]:  # else the other search finds it
                for to, value in zip(out, (word, n, near, near_n)):
                    to.append(value)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                    names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, store: Scratch) -> DataFrame:
    """All ordered pairs (word, n, near, near_n) of words one edit apart."""
    words = store.write(words)
    rows = 4 * words.count()
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    # first halves of words one shorter, equal or longer; last halves likewise
    fronts, backs = [half, half + F.when(size % 2 == 0, -1).otherwise(1)], [half, half + 1]
    sent = words.select("word", "n", F.explode(F.array(*[
        F.struct(F.lit(front).alias("front"),
                 (F.substring("word", F.lit(1), k) if front else F.right("word", k)).alias("key"),
                 (k == (half if front else size - half)).alias("pattern"))
        for front, sizes in ((True, fronts), (False, backs)) for k in sizes])).alias("to")).select(
        "word", "n", "to.*")
    counts = sent.groupBy("front", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > WORDS)
    blocks = counts.select("front", "key", F.ceil(F.col("c") / WORDS).cast("int").alias("blocks"))
    sent = sent.join(blocks, ["front", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # a word is stored in its own block of a half, a pattern asks all blocks
    sent = sent.select("front", "key", "word", "n", "pattern", own.alias("own"), F.explode(
        F.when(F.col("pattern"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    ).alias("block"))
    buckets = max(1, -(-rows // WORDS))
    return sent.select(
        F.pmod(F.xxhash64("front", "key", "block"), F.lit(buckets)).alias("bucket"), "front", "word",
        "n", (F.col("own") == F.col("block")).alias("stored"), "pattern"
    ).groupBy("bucket").applyInArrow(search, PAIRS)


def groups(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    The form is the most frequent word one edit away (of equals the first by code
    points) if it occurs RATIO times as often as the word; the root follows forms to
    the last one.
    """
    store = Scratch(docs.sparkSession)
    words = store.write(vocabulary(docs, id_column, text))
    best = near_words(words, store).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    fits = -F.col("best.less") >= RATIO * F.col("n")
    table = store.write(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n")))
    # forms at least double the count, so chains are short; each round doubles the reach
    chain = store.write(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = store.write(chain.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        store.drop(chain)
        chain = new
        if not moved:
            break
        chain = store.write(new.drop("moved"))
        store.drop(new)
    return table.join(chain.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
