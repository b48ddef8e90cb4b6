"""Exact Jaccard self-join of word n-gram sets, and its connected components.

Sets are ordered by token hash, tokens that more than HOT heads hold last.  Any
order does: with overlap o >= ceil(T * n), two similar sets share at least L tokens
among their first n - ceil(T * n) + L tokens (L-prefix).
Each document picks its own L from the estimated cost of its candidates: a longer
prefix scans more postings and verifies fewer pairs, as a pair needs min(L, L')
shared prefix tokens.

Equal sets are one class from the start.  A prefix holds a frequent token only where
a set has few others, as near copies of a large group do.  A token that more than HOT
classes hold in their prefix is never joined with itself.  Its holders form a group
with a centre (the tokens most of them hold), each holder is replaced by its difference
D to the centre, and since |x ^ y| = |Dx ^ Dy|, two members are similar if
|Dx| + |Dy| <= (|x| + |y|) / 19 (for T = 0.9; all such links are joined to the
member with the smallest slack) or else share a token of their differences.  These
are ordered too: own tokens, which are rare, before missing ones.  With the first
shared token at places i and j, |Dx ^ Dy| is at least i + j and what their lengths
differ by from there on, so holders without a partner near enough leave the list, and
the rest are joined in the same way, level by level.  So a large group of near copies
costs its size, not its square, and no link between components is lost.

Edge cases: null text counts as empty; an empty set links with nothing; repeated
rows and equal ids are separate rows with one component; rows without an id get
the smallest id of their component (null if it has none); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import Scratch

HOT = 64               # holders of a prefix token that are still paired directly
COMMON = 1_000_000     # frequent tokens sent to all tasks (8 MB), the most frequent of them
MERGED_LEVELS = 2      # levels whose groups may span several tokens; then one token is one group
LEVELS_OF_MATCH = 3    # longest L
HEAD = 24              # least number of tokens kept for every row; above LEVELS_OF_MATCH
VERIFY_COST = 20.0     # cost of one verification, in postings read
SETS_PER_TASK = 10_000  # token sets that one task writes
COUNTED_ROWS = 2500    # rows whose tokens are sorted together
BROADCAST_ROWS = 1_000_000  # ids sent to all tasks (8 MB); beyond, rows are shuffled
BROADCAST_LISTS = 2_000_000  # token lists sent to all tasks (64 MB); beyond, they are shuffled


def token_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text (all words where it is shorter)."""
    words = S.words(column, S.separators(S.SPACE_BYTES), lower=True)
    hashes = words.hashes()
    grams = S.windows(hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            own = grams[a:b - width + 1]
        elif b > a:
            own = S.windows(hashes[a:b], b - a) + np.uint64(b - a)
        else:
            own = np.zeros(0, np.uint64)
        out.append(np.unique(own).view(np.int64) if len(own) else own.view(np.int64))
    return [np.sort(x) for x in out]


def set_id(tokens: np.ndarray) -> int:
    """63-bit identity of a set; 0 for the empty set."""
    if not len(tokens):
        return 0
    at = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    total = S.mix(tokens.view(np.uint64) + at * S.BASE).sum(dtype=np.uint64)
    return max(1, int(S.mix(np.array([total], np.uint64))[0]) >> 1)


def required(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def head_size(n: int, percent: int) -> int:
    """Tokens kept for every row: its prefix and some more, as frequent ones give way."""
    return 7 * (n - required(n, percent)) // 5 + HEAD


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of at least 2 n buckets: whether it holds an odd number of tokens.

    Sets that differ in k tokens differ in at most k bits.  The number of buckets is a
    power of two, so the larger of two such maps can be folded to the other's size.
    """
    buckets = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64),
                      minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def list_array(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def scan(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """(key, id, node, n, tokens, bits) of (key, id, text): all tokens, or the smallest ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text"):
            sets = token_sets(batch.column(2), width)
            cut = sets if whole else [s[:head_size(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), list_array(cut),
                 list_array([parity_bits(s) for s in sets])],
                ["key", "id", "node", "n", "tokens", "bits"])

    return docs.mapInArrow(
        run, "key long, id long, node long, n long, tokens array<long>, bits array<long>")


def only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids``: sent to all tasks if few, else by shuffle."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, column, "left_semi")


def sent(table: DataFrame, rows: int) -> DataFrame:
    """A written table, marked to be sent to all tasks if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def close_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def frequent(classes: DataFrame) -> np.ndarray:
    """Sorted tokens that more than HOT heads hold; they only decide an order, so the most
    frequent ones do where there are more than COMMON."""
    often = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT)
    most = often.orderBy(F.desc("c"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(most.column(0).to_numpy())


def rare_first(sets: DataFrame, common: Broadcast, percent: int) -> DataFrame:
    """(node, n, tokens, enough) of (node, n, tokens): the longest prefix, frequent tokens last.

    ``tokens`` may be the smallest ones of a set only; they are enough if they hold a
    whole prefix of rare ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        parts = (b.slice(i, COUNTED_ROWS) for b in batches for i in range(0, b.num_rows, COUNTED_ROWS))
        for batch in parts:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = at - at[0]
            hot = np.zeros(len(flat), bool)
            if len(known):
                hot = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
            prefixes, enough = [], []
            for k, n in enumerate(batch.column(1).to_pylist()):
                own, late = flat[at[k]:at[k + 1]], hot[at[k]:at[k + 1]]
                size = n - required(n, percent) + LEVELS_OF_MATCH
                rare = own[~late]
                enough.append(len(rare) >= size or len(own) == n)
                prefixes.append(np.concatenate([rare, own[late]])[:size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_array(prefixes), pa.array(enough, pa.bool_())],
                ["node", "n", "tokens", "enough"])

    return sets.select("node", "n", "tokens").mapInArrow(
        run, "node long, n long, tokens array<long>, enough boolean")


def all_prefixes(classes: DataFrame, tokens_of, percent: int, store: Scratch) -> list[DataFrame]:
    """Tables (node, n, tokens, enough): the longest prefix of every class, rare tokens first,
    in the rows that have enough."""
    common = classes.sparkSession.sparkContext.broadcast(frequent(classes))
    ordered = store.write(rare_first(classes, common, percent))
    lacking = ordered.where("NOT enough").select("node", "n")
    if not lacking.limit(1).count():
        return [ordered]
    whole = tokens_of(lacking.select("node"))
    rest = store.write(rare_first(whole.join(lacking, "node"), common, percent))
    store.drop(whole)
    return [ordered, rest]


def first_level(classes: DataFrame, tokens_of, percent: int, store: Scratch
                ) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, hits) and members (g, node, n) of hot groups.

    Pairs come from short lists with adaptive L; of a hot list, each holder is paired
    with the list's first one only.
    """
    base = f"(n - ceil({percent} * n / 100))"
    prefixes = all_prefixes(classes, tokens_of, percent, store)
    postings = reduce(DataFrame.union, prefixes).where("enough").select(
        "node", "n", F.element_at("tokens", -1).alias("reach"), F.posexplode("tokens"))
    postings = postings.withColumnRenamed("col", "token")
    lists = store.write(postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.max("reach").alias("g"), F.min("node").alias("pivot")
    ).where("c > 1"))
    shared = store.write(postings.join(sent(lists, BROADCAST_LISTS), "token"))
    scans = [F.sum(F.expr(f"CASE WHEN c <= {HOT} AND pos < {base} + {k} THEN c - 1 ELSE 0 END"))
             for k in range(1, LEVELS_OF_MATCH + 1)]
    costs = shared.groupBy("node").agg(
        F.max("n").alias("_n"), *[s.cast("double").alias(f"s{k}") for k, s in enumerate(scans, 1)])
    options = [F.when(F.expr(f"ceil({percent} * _n / 100) >= {k}"), F.struct(
        (F.col(f"s{k}") * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("need")))
        for k in range(1, LEVELS_OF_MATCH + 1)]
    need = costs.select("node", F.array_min(F.array_compact(F.array(*options)))["need"].alias("need"))
    short = shared.where(F.col("c") <= HOT).join(need, "node").where(f"pos < {base} + need")
    hot = shared.where((F.col("c") > HOT) & (F.col("node") != F.col("pivot")))
    stars = hot.groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("hits"))
    left, right = (short.select(
        "token", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("need").alias(f"need_{x}"))
        for x in "ab")
    pairs = store.write(
        left.join(right, "token").where(
            (F.col("a") < F.col("b")) & F.expr(close_sizes("na", "nb", percent)))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("hits"), F.min(F.least("need_a", "need_b")).alias("need"))
        .where("hits >= need").select("a", "b", "hits").union(stars))
    members = store.write(shared.where(F.col("c") > HOT).select("g", "node", "n").distinct())
    store.drop(shared, lists, *prefixes)
    return pairs, members


def group_counts(members: DataFrame, least: int) -> DataFrame:
    """(g, token, cnt) summed per batch before the shuffle.

    A centre may be any set, so what fewer than ``least`` members of a batch hold may
    be left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, COUNTED_ROWS) for b in batches for i in range(0, b.num_rows, COUNTED_ROWS))
        for batch in parts:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            groups = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            order = np.lexsort((flat, groups))
            groups, flat = groups[order], flat[order]
            new = np.ones(len(flat), bool)
            new[1:] = (groups[1:] != groups[:-1]) | (flat[1:] != flat[:-1])
            at = np.flatnonzero(new)
            both = np.stack([groups[at], flat[at]], 1)
            count = np.diff(np.append(at, len(flat)))
            both, count = both[count >= least], count[count >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(count.astype(np.int64))],
                ["g", "token", "cnt"])

    return members.select("g", "tokens").mapInArrow(run, "g long, token long, cnt long").groupBy(
        "g", "token").agg(F.sum("cnt").alias("cnt"))


def differences(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """(g, node, n, root, size, f, d) of (g, node, n, root, tokens).

    ``size`` is that of the difference, ``f`` its slack and ``d`` its prefix: tokens that
    the centre lacks, then those that the member lacks.
    """
    centre = F.coalesce("centre", F.array().cast("array<long>"))
    d = F.concat(F.sort_array(F.array_except("tokens", centre)),
                 F.sort_array(F.array_except(centre, "tokens")))
    near = members.join(centres, "g", "left").select("g", "node", "n", "root", d.alias("d"))
    # the first shared token is at most at place (100 - T) / (100 + T) * (1 + 100 / T) * n
    return near.select(
        "g", "node", "n", "root", F.size("d").cast("long").alias("size"),
        (F.size("d") * (100 + percent) - F.col("n") * (100 - percent)).alias("f"),
        F.expr(f"slice(d, 1, cast(floor({100 - percent} * n / {percent}) + 1 as int))").alias("d"))


def near_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that hold a token of their differences at places
    where the first one of similar sets may be."""
    left, right = (shared.select(
        "g", "token", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"),
        F.col("inside").alias(f"in_{x}"), F.col("pos").alias(f"i{x}"),
        (F.col("size") - F.col("pos")).alias(f"left_{x}")) for x in "ab")
    return left.join(right, ["g", "token"]).where(
        (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & ~(F.col("in_a") & F.col("in_b"))
        & F.expr(close_sizes("na", "nb", percent))
        & F.expr(f"{100 + percent} * (ia + ib + abs(left_a - left_b)) <= {100 - percent} * (na + nb)")
    ).select("a", "b").distinct()


def open_lists(postings: DataFrame) -> DataFrame:
    """(g, token, c, lo, most, to) of tokens that members of different components hold,
    not all of them linked to the best member."""
    return postings.groupBy("g", "token").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("lo"), F.max("n").alias("most"),
        F.max("reach").alias("to"), F.min("root").alias("_low"), F.max("root").alias("_high"),
        F.min("inside").alias("_closed")).where("_low <> _high AND NOT _closed").drop(
        "_low", "_high", "_closed")


def centre_level(members: DataFrame, rows: int, percent: int, merged: bool, store: Scratch
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(certain links, candidate pairs, members of the next level's groups).

    Where groups are not merged, all members of a next group differ from this centre in
    its token alike, and every token is counted: the next centre agrees with all of them
    there.  So each such level settles one more token, and the levels come to an end.
    """
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    centres = store.write(
        group_counts(members, 2 if merged else 1).join(sizes, "g").where("2 * cnt > m")
        .groupBy("g").agg(F.array_agg("token").alias("centre")), rows, SETS_PER_TASK)
    near = store.write(differences(members, centres, percent), rows, SETS_PER_TASK)
    best = store.write(near.groupBy("g").agg(F.min(F.struct("f", "node")).alias("best")))
    # inside: linked to the best member for certain, so pairs of such members add nothing
    near_best = near.join(best, "g", "left").withColumn("inside", F.expr("f + best.f <= 0"))
    links = store.write(near_best.where("inside AND node <> best.node").select(
        F.col("best.node").alias("a"), F.col("node").alias("b")), rows)
    postings = near_best.select(
        "g", "node", "n", "root", "size", "inside", F.element_at("d", -1).alias("reach"),
        F.posexplode("d").alias("pos", "token"))
    lists = store.write(open_lists(postings))
    # holders that may have a partner: none comes before the list's first place
    some = store.write(postings.join(sent(lists, BROADCAST_LISTS), ["g", "token"]).where(
        F.expr(f"{100 + percent} * (pos + lo) <= {100 - percent} * (n + least(most, 100 * n / {percent}))")
    ).drop("c", "lo", "most", "to"))
    still = store.write(open_lists(some).drop("lo", "most"))
    shared = store.write(some.join(sent(still, BROADCAST_LISTS), ["g", "token"]))
    pairs = store.write(near_pairs(shared.where(F.col("c") <= HOT), percent))
    deeper = store.write(shared.where(F.col("c") > HOT).select(
        F.xxhash64("g", "to" if merged else "token").alias("g"), "node", "n", "root").distinct())
    store.drop(centres, near, best, lists, some, still, shared)
    return links, pairs, deeper


def by_centres(members: DataFrame, tokens_of, percent: int, store: Scratch
               ) -> tuple[list[DataFrame], list[DataFrame]]:
    """(certain links, candidate pairs) of groups (g, node, n, root), level by level."""
    all_links, all_pairs, level = [], [], 0
    members = store.write(members)
    if not members.limit(1).count():
        return all_links, all_pairs
    tokens = tokens_of(members.select("node").distinct())
    while rows := members.count():
        links, pairs, deeper = centre_level(
            members.join(tokens, "node"), rows, percent, level < MERGED_LEVELS, store)
        store.drop(members)
        members = deeper
        all_links.append(links)
        all_pairs.append(pairs)
        level += 1
    store.drop(tokens)
    return all_links, all_pairs


def plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity bits (node, n, bits) do not differ more than those of similar sets may.

    Similar sets are close in size, so one map is at most twice as long as the other.
    """
    side = lambda x: maps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"),
                                 F.col("bits").alias(f"b{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.expr(close_sizes("na", "nb", percent)))
    words = F.least(F.size("ba"), F.size("bb"))

    def folded(x: str) -> Column:
        return F.when(F.size(x) == words, F.col(x)).otherwise(F.zip_with(
            F.slice(x, 1, words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q)))

    apart = F.aggregate(
        F.zip_with(folded("ba"), folded("bb"), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
        F.lit(0), lambda total, k: total + k)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))
                      ).select("a", "b")


def components(edges: DataFrame, store: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge."""
    both = store.write(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    rows = both.count()
    state = store.write(both.select(F.col("a").alias("node")).distinct().withColumn(
        "root", F.col("node")), rows)
    while True:
        offered = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("best"))
        step = store.write(state.join(offered, "node").select(
            "node", "root", F.least("root", "best").alias("low")), rows)
        # a node whose root moved tells its old root, then everyone jumps to the root's root
        told = step.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        merged = step.join(told, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("low", F.coalesce("told", "low")).alias("low"))
        jump = merged.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = store.write(merged.join(jump, "low").select(
            "node", "old", F.col("next").alias("root")), rows)
        store.drop(state, step)
        moved = new.where("root <> old").limit(1).count()
        state = new
        if not moved:
            store.drop(both)
            return state.select("node", "root")


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not yet in one component."""
    named = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    return pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (g, node, n, root) of the groups that lie in more than one component."""
    named = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = named.groupBy("g").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return named.join(open_, "g", "left_semi").select("g", "node", "n", "root")


def merged_roots(labels: DataFrame, links: list[DataFrame], store: Scratch) -> DataFrame:
    """(node, root) after more links: only roots that they join are worked out anew."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = reduce(DataFrame.union, [x.select("a", "b") for x in links]).join(
        side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    moved = components(joined, store).withColumnRenamed("root", "last")
    old = labels.select("node", F.col("root").alias("old"))
    # nodes without an earlier root are their own
    alone = moved.join(labels.select("node"), "node", "left_anti").select(
        "node", F.col("last").alias("root"))
    return old.join(moved.select(F.col("node").alias("old"), "last"), "old", "left").select(
        "node", F.coalesce("last", "old").alias("root")).unionByName(alone)


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets."""
    overlap = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        .where(100 * overlap >= percent * (F.size("ta") + F.size("tb") - overlap))
        .select("a", "b"))


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(key, id, text); rows without an id are found again by their text."""
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.xxhash64(F.col(text))).alias("key"),
        F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))


def split_classes(sets: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """((id, node, n) of every row, one row of each class); ``sets`` is written once before.

    All rows of a class hold the same, so any may stand for it.
    """
    sets = store.write(sets.withColumn("row", F.monotonically_increasing_id()))
    first = store.write(sets.where("n > 0").groupBy("node").agg(F.min("row").alias("row")).select("row"))
    classes = store.write(only(sets, first, "row").drop("row", "id"))
    named = store.write(sets.select("id", "node", "n"))
    store.drop(sets, first)
    return named, classes


def labelled(named: DataFrame, roots: DataFrame, id_column: str) -> DataFrame:
    """(id_column, n_shingles, component_id) of every row."""
    rows = named.join(roots, "node", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    smallest = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("first"))
    return rows.join(smallest, "root", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.coalesce("first", "id").alias("component_id"))


class Tokens:
    """Full sets of classes, scanned again from the texts."""

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int, percent: int, store: Scratch):
        self.rows, self.width, self.percent, self.store = rows, width, percent, store
        self.keys = classes.select("node", "key")
        self.maps = classes.select("node", "n", "bits")

    def of(self, nodes: DataFrame) -> DataFrame:
        wanted = self.store.write(self.keys.join(nodes, "node", "left_semi"))
        rows = wanted.count()
        found = scan(only(self.rows, wanted.select("key").distinct(), "key"),
                     self.width, self.percent, whole=True)
        # rows that repeat an id are told apart by their set
        out = self.store.write(found.join(wanted, ["node", "key"], "left_semi").select(
            "node", "tokens").dropDuplicates(["node"]), rows, SETS_PER_TASK)
        self.store.drop(wanted)
        return out

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar on their full sets."""
        pairs = self.store.write(plausible(pairs, self.maps, self.percent))
        tokens = self.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        links = self.store.write(verified(pairs, tokens, self.percent))
        self.store.drop(pairs, tokens)
        return links


def link(docs: DataFrame, id_column: str, text: str, width: int = 3, percent: int = 90
         ) -> DataFrame:
    """(id_column, n_shingles, component_id) of every row of ``docs``."""
    store = Scratch(docs.sparkSession)
    rows = keyed(docs, id_column, text)
    named, classes = split_classes(scan(rows, width, percent, whole=False), store)
    tokens = Tokens(rows, classes, width, percent, store)
    pairs, members = first_level(classes, tokens.of, percent, store)
    # a set and the one that it shares most tokens with first; then what is not linked by that
    best = pairs.groupBy(F.col("b").alias("y")).agg(F.max_by("a", "hits").alias("a")).select(
        "a", F.col("y").alias("b"))
    labels = components(tokens.confirm(best), store)
    certain, more = by_centres(undecided(members, labels), tokens.of, percent, store)
    candidates = reduce(DataFrame.union, [crossing(pairs.select("a", "b"), labels), *more])
    late = tokens.confirm(candidates.distinct())
    store.drop(classes, pairs, members, *more)
    return labelled(named, merged_roots(labels, [late, *certain], store), id_column)
