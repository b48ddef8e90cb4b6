"""Near-duplicates by fast similarity sketches, banding and exact verification.

A sketch has COORDINATES places.  In round i every token of a set is hashed to a
place and a value i + fraction, and a place keeps its least value; the first
COORDINATES rounds throw tokens into random places, the next ones throw all of them
into place 0, 1, 2, ..., so every place is filled, for sets of any size.  Places of
two sets agree with the probability of their Jaccard similarity, with concentration
bounds, after about n + t log t hashes instead of n t.

BANDS bands of ROWS places are bucket keys.  At similarity 0.85 two sets share no
band with probability (1 - 0.85^ROWS)^BANDS, about 2e-7.  Candidates are settled in
two passes, each verified on full sets: first every set with the pivot of its
buckets that it shares most bands with; then only pairs that are not yet in one
component, so a group of near copies costs its size and not its square.  Buckets with
more than PARTNERS such pairs a set are never joined with themselves: the sets of
connected buckets of this kind are replaced by their differences to a common centre (see ``jaccard``),
level by level, until all lists are short.

Equal sets are one class from the start, so copies are never paired.

Edge cases: null text counts as empty; an empty set links with nothing and is kept;
repeated rows and equal ids are separate rows with one component; rows without an id
get the smallest id of their component (null if it has none) and are not kept where
another row of it has an id; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordquant.llm import jaccard
from fjordquant.llm import textscan as S
from fjordquant.llm.common import Scratch

ROWS, BANDS = 8, 48
COORDINATES = ROWS * BANDS
PARTNERS = 16           # sets of other components that a bucket pairs each set with, on average
HASHES_AT_ONCE = 1 << 16
NO_VALUE = np.uint64((1 << 64) - 1)


def sketches(tokens: np.ndarray, first: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """(documents, places) least values; row k sketches tokens[first[k]:first[k + 1]].

    A round's values exceed those of all earlier rounds, so hashing more rounds than
    needed changes nothing; sets leave once all their places are filled.
    """
    size = np.diff(first)
    out = np.full((len(size), places), NO_VALUE, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(size)), size)
    left, step = np.flatnonzero(size > 0), 0
    while len(left) and step < 2 * places:
        rounds = np.arange(step, min(2 * places, step + max(1, HASHES_AT_ONCE // len(owner))))
        step += len(rounds)
        salt = S.mix(rounds.astype(np.uint64) + np.uint64(1))[:, None]
        h = S.mix(tokens[None, :] ^ salt)
        place = ((h >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        place = np.where(rounds[:, None] < places, place, rounds[:, None] - places)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, (owner[None, :] * places + place).reshape(-1), value.reshape(-1))
        open_ = np.zeros(len(size), bool)
        open_[left] = (out[left] == NO_VALUE).any(1)
        keep = open_[owner]
        tokens, owner, left = tokens[keep], owner[keep], left[open_[left]]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys."""
    parts = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(S.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        key = S.mix(key * S.BASE + parts[:, :, k])
    return key.view(np.int64)


def scan(docs: DataFrame, width: int) -> DataFrame:
    """(key, id, node, n, bands, bits) of (key, id, text); empty sets have no band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text"):
            sets = jaccard.token_sets(batch.column(2), width)
            size = np.array([len(s) for s in sets], np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            keys = band_keys(sketches(np.concatenate(sets).view(np.uint64), first))
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[size > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([jaccard.set_id(s) for s in sets], pa.int64()), pa.array(size), bands,
                 jaccard.list_array([jaccard.parity_bits(s) for s in sets])],
                ["key", "id", "node", "n", "bands", "bits"])

    return docs.mapInArrow(
        run, "key long, id long, node long, n long, bands array<long>, bits array<long>")


def bucket_groups(large: DataFrame, store: Scratch) -> DataFrame:
    """Members (g, node, n, root) of the groups of (bucket, all, node, n, root); ``all`` is
    the size of a bucket.

    Buckets that share a set are one group, so every set is in one group only.  A set
    links each of its buckets to its largest one; as near copies share the largest
    buckets, few of these links differ, and only those are followed.
    """
    first = store.write(large.groupBy("node").agg(
        F.min("n").alias("n"), F.min("root").alias("root"),
        F.max(F.struct("all", "bucket"))["bucket"].alias("first")))
    links = large.join(first.select("node", "first"), "node").where("bucket <> first").select(
        F.col("first").alias("a"), F.col("bucket").alias("b")).distinct()
    group = jaccard.components(links, store).select(F.col("node").alias("first"), F.col("root").alias("g"))
    # a bucket without a link is a group of its own
    return first.join(group, "first", "left").select(
        F.coalesce("g", "first").alias("g"), "node", "n", "root")


def near_duplicates(docs: DataFrame, id_column: str, text: str, width: int = 5, percent: int = 85
                    ) -> DataFrame:
    """(id_column, n_shingles, component_id, kept) of every row of ``docs``."""
    store = Scratch(docs.sparkSession)
    rows = jaccard.keyed(docs, id_column, text)
    named, classes = jaccard.split_classes(scan(rows, width), store)
    tokens = jaccard.Tokens(rows, classes, width, percent, store)
    postings = classes.select("node", "n", F.explode("bands").alias("bucket"))
    lists = store.write(postings.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).where("c > 1"))
    shared = store.write(postings.join(jaccard.sent(lists, jaccard.BROADCAST_LISTS), "bucket"))
    best = (shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("hits"))
            .groupBy(F.col("node").alias("b")).agg(F.max_by("pivot", "hits").alias("a")))
    labels = jaccard.components(tokens.confirm(best.select("a", "b")), store)

    # what is left: sets of different components in one bucket
    state = shared.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = state.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("s")).groupBy("bucket").agg(
        F.max_by("root", "s").alias("main"), F.sum("s").alias("all"),
        F.expr("(sum(s) * sum(s) - sum(s * s)) / 2").alias("crossing")).where("crossing > 0")
    rest = store.write(state.join(mixed, "bucket").withColumn(
        "large", F.col("crossing") > PARTNERS * F.col("all")))
    store.drop(shared, lists)
    # pairs of the bucket's main component are left out on one side of the join
    left, right = (rest.where("NOT large").select(
        "bucket", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"),
        (F.col("root") == F.col("main")).alias(f"main_{x}")) for x in "ab")
    pairs = left.where("NOT main_a").join(right, "bucket").where(
        (F.col("main_b") | (F.col("a") < F.col("b"))) & (F.col("ra") != F.col("rb"))
        & F.expr(jaccard.close_sizes("na", "nb", percent))).select("a", "b")
    large = store.write(rest.where("large").select("bucket", "all", "node", "n", "root"))
    certain = []
    if large.limit(1).count():
        certain, more = jaccard.by_centres(bucket_groups(large, store), tokens.of, percent, store)
        pairs = reduce(DataFrame.union, [pairs, *more])
    late = tokens.confirm(pairs.distinct())
    store.drop(classes, rest, large)
    roots = jaccard.merged_roots(labels, [late, *certain], store)
    return jaccard.labelled(named, roots, id_column).withColumn(
        "kept", F.col(id_column).eqNullSafe(F.col("component_id")))
