"""Industry nodes, peer groups and peer multiples, keyed by (as_of, ...).

Every operator takes a universe with an ``as_of`` column, so one job serves one
snapshot or all month ends.  A top industry may hold a large part of the market;
its members are therefore never collected: counts and sums are partial
aggregates, quantiles and positions come from ``functions.ordering``, and the
ten largest peers come from a per-node top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip, ratio_if_positive, weighted_mean
from fjordquant.functions.ordering import (
    grouped_order_stats,
    grouped_quantiles,
    reread_quantiles,
    sorted_quantile,
    with_share_at_most,
)
from fjordquant.operators.cleaning import clean_multiples
from fjordquant.operators.universe import nodes

NODE = ["as_of", "level", "node"]
STAT_METRICS = ["pe", "pb", "roe", "net_margin", "ni_growth"]
PEER_METRICS = ["pe", "pb", "ev_ebitda", "roe", "net_margin", "ni_growth"]
RETURNS = ["ret_1m", "ret_3m", "ret_ytd", "ret_1y"]
TOP_PEERS = 10


def unpivot(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics]))
    return df.select(*keep, pairs.alias("_m")).select(*keep, "_m.metric", "_m.value")


def node_rows(universe: DataFrame, *extra: str) -> DataFrame:
    return nodes(universe, "as_of", "symbol", *extra)


def node_quantiles(universe: DataFrame, metrics: list[str], probs: dict[str, float],
                   min_values: int = 1, quantiles=grouped_quantiles) -> DataFrame:
    """(as_of, level, node, metric, quantiles, n) over cleaned liquid members."""
    rows = unpivot(node_rows(clean_multiples(universe), *metrics), NODE, metrics)
    return quantiles(rows, [*NODE, "metric"], "value", probs).where(
        F.col("n") >= min_values)


def index_returns(index: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """Session-lag and year-to-date returns of the index at every session."""
    w = Window.orderBy("time")
    year = Window.orderBy(F.year("time")).rangeBetween(-1, -1)
    prior = F.max(F.struct("time", "close")).over(year)["close"]
    c = F.col("close")
    return index.select(
        F.col("time").alias("as_of"),
        *[(c / F.lag("close", n).over(w) - 1).alias(f"bench_{k}")
          for k, n in (("ret_1m", 21), ("ret_3m", 63), ("ret_1y", 250))],
        (c / prior - 1).alias("bench_ret_ytd"))


def node_stats(universe: DataFrame, index_rets: DataFrame) -> DataFrame:
    """Counts, value, aggregate P/E, cap-weighted and excess returns per node."""
    cap, ni = F.col("market_cap"), F.col("net_income_parent")
    rows = node_rows(universe, "market_cap", "net_income_parent", "liquidity_flag", "has_bctc",
                     "avg_value_20d", *RETURNS)
    both = cap.isNotNull() & ni.isNotNull()

    def weighted(c: str) -> Column:
        ok = F.col(c).isNotNull() & (cap > 0)
        return (F.sum(F.when(ok, F.col(c) * cap)) / F.sum(F.when(ok, cap))).alias(c)

    stats = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if("liquidity_flag").alias("n_liquid"),
        F.count_if("has_bctc").alias("n_with_bctc"),
        F.coalesce(F.sum("market_cap"), F.lit(0.0)).alias("market_cap"),
        F.coalesce(F.sum("avg_value_20d"), F.lit(0.0)).alias("avg_value_20d"),
        ratio_if_positive(F.sum(F.when(both, cap)), F.sum(F.when(both, ni))).alias("pe_aggregate"),
        *[weighted(c) for c in RETURNS])
    total = universe.groupBy("as_of").agg(F.sum("market_cap").alias("total_cap"))
    out = stats.join(total, "as_of").join(index_rets, "as_of", "left").withColumn(
        "market_weight", F.try_divide("market_cap", "total_cap"))
    return out.withColumns({
        f"{c}_vs_index": F.col(c) - F.col(f"bench_{c}") for c in RETURNS
    }).drop("total_cap", *[f"bench_{c}" for c in RETURNS])


def largest_members(universe: DataFrame, k: int = 5) -> DataFrame:
    """The k largest members of each node by market value (per-node top-k)."""
    order = Window.partitionBy(*NODE).orderBy(F.desc_nulls_last("market_cap"), "symbol")
    return node_rows(universe, "market_cap").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sector_score(ret_3m: Column, ret_1y: Column, roe: Column, macro: Column) -> Column:
    """40 % momentum against the index, 30 % median ROE, 30 % macro, renormalised."""
    n = ret_3m.isNotNull().cast("double") + ret_1y.isNotNull().cast("double")
    total = F.coalesce(ret_3m, F.lit(0.0)) + F.coalesce(ret_1y, F.lit(0.0))
    momentum = clip(50 + F.when(n > 0, total / n) * 200, 0.0, 100.0)
    quality = clip(50 + (roe - 0.12) * 400, 0.0, 100.0)
    return weighted_mean([(momentum, 0.4), (quality, 0.3), (macro, 0.3)])


def legacy_sector_score(sector_3m: Column, bench_3m: Column, sector_6m: Column, bench_6m: Column,
                        roe: Column) -> Column:
    """The older peer path's score: 3m/6m excess and median ROE."""
    return clip(weighted_mean([
        (50 + (sector_3m - bench_3m) * 250, 0.5), (50 + (sector_6m - bench_6m) * 250, 0.5),
        (40 + (roe - 0.12) * 300, 0.4)]), 0.0, 100.0)


def sector_table(universe: DataFrame, index_rets: DataFrame, impacts: DataFrame) -> DataFrame:
    """Every node with its dominant company type, score and ranks per metric."""
    stats = node_stats(universe, index_rets)
    by_type = node_rows(universe, "market_cap", "company_type").groupBy(
        *NODE, "company_type").agg(F.sum("market_cap").alias("c"), F.count(F.lit(1)).alias("k"))
    # largest value first, then the most frequent, then the first name
    best = F.struct(
        F.coalesce("c", F.lit(-1.0)).alias("c"),
        F.when(F.col("c").isNull(), F.col("k")).otherwise(0).alias("k"))
    dominant = by_type.groupBy(*NODE).agg(F.max_by("company_type", best).alias("company_type"))
    roe = node_quantiles(universe, ["roe"], {"roe_median": 0.5}).select(*NODE, "roe_median")
    df = stats.join(dominant, NODE).join(roe, NODE, "left").join(impacts, "company_type", "left")
    df = df.withColumn("score", sector_score(
        F.col("ret_3m_vs_index"), F.col("ret_1y_vs_index"), F.col("roe_median"), F.col("impact")))
    for c in [*RETURNS, "score"]:
        order = Window.partitionBy("as_of", "level").orderBy(F.desc_nulls_last(c))
        df = df.withColumn(f"rank_{c}", F.when(F.col(c).isNotNull(), F.rank().over(order)))
    return df


def market_tree(universe: DataFrame, period: str = "ret_1m") -> DataFrame:
    """The tree as rows: every node with its path, parent, size, median return, count.

    A node is its whole path, so equal names under two parents stay apart.
    """
    names = [f"icb{k}" for k in (1, 2, 3, 4)]
    levels = F.array(*[F.struct(
        F.lit(k).alias("level"), F.concat_ws("/", *names[:k]).alias("path"),
        F.col(names[k - 1]).alias("node"),
        (F.col(names[k - 2]) if k > 1 else F.lit(None).cast("string")).alias("parent"))
        for k in (1, 2, 3, 4)])
    rows = universe.select("market_cap", F.col(period).alias("value"), F.explode(levels).alias("l")
                           ).select("l.*", "market_cap", "value")
    keys = ["level", "path"]
    sizes = rows.groupBy(*keys, "node", "parent").agg(
        F.coalesce(F.sum("market_cap"), F.lit(0.0)).alias("size"), F.count(F.lit(1)).alias("count"))
    medians = grouped_quantiles(rows, keys, "value", {"value": 0.5}).select(*keys, "value")
    inner = sizes.join(medians, keys, "left")
    leaves = universe.select(
        F.lit(5).alias("level"), F.concat_ws("/", *names, F.col("symbol").cast("string")).alias("path"),
        F.col("symbol").cast("string").alias("node"), F.col("icb4").alias("parent"),
        F.coalesce("market_cap", F.lit(0.0)).alias("size"),
        F.lit(1).cast("long").alias("count"), F.col(period).alias("value"))
    return inner.unionByName(leaves)


def market_breadth(universe: DataFrame) -> DataFrame:
    cap, ni = F.col("market_cap"), F.col("net_income_parent")
    both = cap.isNotNull() & ni.isNotNull()
    up, down = F.count_if(F.col("change_1d") > 0), F.count_if(F.col("change_1d") < 0)
    n = F.count(F.lit(1))
    return universe.groupBy("as_of").agg(
        n.alias("n_symbols"), F.sum("market_cap").alias("market_cap"),
        up.alias("advancers"), down.alias("decliners"), (n - up - down).alias("unchanged"),
        F.count_if("has_bctc").alias("n_with_bctc"), F.count_if("liquidity_flag").alias("n_liquid"),
        F.count_if(F.col("icb1") == S.UNCLASSIFIED).alias("n_unclassified"),
        F.avg((F.col("icb1") != S.UNCLASSIFIED).cast("double")).alias("industry_coverage"),
        ratio_if_positive(F.sum(F.when(both, cap)), F.sum(F.when(both, ni))).alias("pe_aggregate"))


def movers(universe: DataFrame, k: int = 5) -> DataFrame:
    liquid = universe.where("liquidity_flag").where(F.col("change_1d").isNotNull()).select(
        "symbol", "price", "change_1d")

    def top(order: Column, side: str) -> DataFrame:
        best = liquid.orderBy(order, "symbol").limit(k)
        return best.withColumns({
            "side": F.lit(side), "rank": F.row_number().over(Window.orderBy(order, "symbol"))})

    return top(F.desc("change_1d"), "gainer").unionByName(top(F.asc("change_1d"), "loser"))


# ------------------------------------------------------------------ peer groups
def peer_levels(universe: DataFrame, min_liquid: int = 5) -> DataFrame:
    """(as_of, symbol, level, node): the finest level with enough liquid members."""
    rows = node_rows(universe, "liquidity_flag")
    counts = rows.groupBy(*NODE).agg(
        F.count_if("liquidity_flag").alias("n_liquid"), F.count(F.lit(1)).alias("n_peers"))
    # one row a node and date, so the counts are sent to the members
    usable = rows.select(*NODE, "symbol").join(F.broadcast(counts), NODE).where(
        (F.col("n_liquid") >= min_liquid) | (F.col("level") == 1))
    pick = F.max(F.struct("level", "node", "n_peers", "n_liquid")).alias("p")
    return usable.groupBy("as_of", "symbol").agg(pick).select("as_of", "symbol", "p.*")


def peer_quantiles(universe: DataFrame) -> DataFrame:
    """Wide p25/p50/p75 of the six peer metrics per node (at least 3 values)."""
    q = node_quantiles(universe, PEER_METRICS, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, 3)
    return q.groupBy(*NODE).pivot("metric", PEER_METRICS).agg(
        F.first("p25").alias("p25"), F.first("p50").alias("p50"), F.first("p75").alias("p75"))


def peer_positions(universe: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of the peer group at or below the symbol's own value, per metric."""
    metrics = ["pe", "pb", "roe", "net_margin", "ni_growth", "ret_1y", "market_cap"]
    rows = unpivot(node_rows(universe, *metrics), [*NODE, "symbol"], metrics)
    rows = rows.where(F.col("value").isNotNull())
    placed = with_share_at_most(rows, [*NODE, "metric"], "value", "position", 3)
    return placed.join(levels.select(*NODE, "symbol"), [*NODE, "symbol"])


def peer_comparison(universe: DataFrame, levels: DataFrame) -> DataFrame:
    """Multiples of the comparison peers of every symbol.

    The peers are the ten largest liquid members other than the symbol itself
    above the first value threshold that leaves two; ten largest others are
    always among the node's eleven largest, so eleven rows per node decide.
    """
    cols = ["symbol", "market_cap", "net_income_parent", "equity_parent", "ni_ttm"]
    liquid = universe.where(F.col("liquidity_flag") & (F.col("market_cap") > 0))
    rows = node_rows(liquid, *[c for c in cols if c != "symbol"])
    order = Window.partitionBy(*NODE).orderBy(F.desc("market_cap"), "symbol")
    entry = F.struct("_r", *cols)
    top = rows.withColumn("_r", F.row_number().over(order)).where(
        F.col("_r") <= TOP_PEERS + 1).groupBy(*NODE).agg(
        F.array_sort(F.collect_list(entry)).alias("top"))
    cut = grouped_quantiles(rows, NODE, "market_cap", {"cap_p90": 0.9}, "n_all")
    df = levels.select("as_of", "symbol", "level", "node").join(
        universe.select("as_of", "symbol", "market_cap", "liquidity_flag"), ["as_of", "symbol"]
    ).join(F.broadcast(top), NODE, "left").join(cut, NODE, "left")
    own = F.col("symbol")
    df = df.withColumn("others", F.slice(F.filter(
        F.coalesce("top", F.array().cast(df.schema["top"].dataType)),
        lambda x: x["symbol"] != own), 1, TOP_PEERS))
    chosen, used = F.col("others"), F.lit(None).cast("double")
    for fraction in (0.0, 0.01, 0.05, 0.10):
        floor = F.col("market_cap") * fraction
        near = F.filter("others", lambda x: x["market_cap"] >= floor)  # noqa: B023
        good = (F.col("market_cap") > 0) & (F.size(near) >= 2)
        chosen = F.when(good, near).otherwise(chosen)
        used = F.when(good, F.lit(fraction)).otherwise(used)
    df = df.withColumns({"peers": chosen, "cap_threshold": used})

    def pe_den(x: Column) -> Column:
        return F.when(x["ni_ttm"] > 0, x["ni_ttm"]).otherwise(x["net_income_parent"])

    def pb_den(x: Column) -> Column:
        return x["equity_parent"]

    def multiples(den, keep) -> Column:
        valid = F.filter("peers", lambda x: den(x) > 0)
        return F.filter(F.transform(valid, lambda x: x["market_cap"] / den(x)), keep)

    def gross(den) -> Column:
        valid = F.filter("peers", lambda x: den(x) > 0)
        cap = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x["market_cap"])
        low = F.aggregate(valid, F.lit(0.0), lambda a, x: a + den(x))
        return F.when(low > 0, cap / low)

    self_liquid = (F.col("liquidity_flag") & (F.col("market_cap") > 0)).cast("long")
    df = df.withColumns({
        "_pe": F.sort_array(multiples(pe_den, lambda m: m < 60)),
        "_pb": F.sort_array(multiples(pb_den, lambda m: m <= 20)),
    })

    def pick(c: str, p: float) -> Column:
        return F.when(F.size(c) >= 2, sorted_quantile(F.col(c), p))

    return df.select(
        "as_of", "symbol", "level", "node", "cap_threshold",
        F.size("peers").alias("peer_count"),
        (F.coalesce("n_all", F.lit(0)) - self_liquid).alias("liquid_peer_count"),
        F.array_join(F.transform("peers", lambda x: x["symbol"].cast("string")), ",")
        .alias("peer_symbols"),
        F.coalesce(F.col("market_cap") >= F.col("cap_p90"), F.lit(False)).alias("top_decile"),
        pick("_pe", 0.25).alias("pe_p25"), pick("_pe", 0.5).alias("pe_p50"),
        pick("_pe", 0.75).alias("pe_p75"), pick("_pb", 0.25).alias("pb_p25"),
        pick("_pb", 0.5).alias("pb_p50"), pick("_pb", 0.75).alias("pb_p75"),
        pick("_pb", 0.9).alias("pb_p90"),
        gross(pe_den).alias("pe_gross"), gross(pb_den).alias("pb_gross"))


def pb_roe_regression(universe: DataFrame, levels: DataFrame) -> DataFrame:
    """P/B on ROE over the liquid peers without the symbol itself.

    Leaving one out needs no self-join: the node's sums minus the symbol's own
    terms give the fit, and leaving one value out of a sorted list shifts the
    positions above it by one, which gives the clipping quantiles.  The own value lies
    above a position if and only if it exceeds the value there, so nobody is ranked.
    """
    clean = clean_multiples(universe).where(
        F.col("pb").isNotNull() & (F.col("roe") > -0.2) & (F.col("roe") < 0.6))
    rows = node_rows(clean, "pb", "roe")
    x, y = F.col("roe"), F.col("pb")
    sums = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    t = F.col("_total")
    spots: dict[str, Column] = {}
    for tag, p in (("lo", 0.25), ("hi", 0.9)):
        for k in (0, 1, 2):
            spots[f"{tag}_all{k}"] = F.floor((t - 1) * p) + k
            spots[f"{tag}_rest{k}"] = F.floor((t - 2) * p) + k
    order = grouped_order_stats(rows, NODE, "pb", spots)
    # of the four nodes of a symbol only the one it is compared in
    names = F.array(*[f"icb{k}" for k in (1, 2, 3, 4)])
    own = clean.select("as_of", "symbol", "pb", "roe", names.alias("_names")).join(
        levels.select(*NODE, "symbol"), ["as_of", "symbol"]).where(
        F.get("_names", F.col("level") - 1) == F.col("node"))
    # a symbol has one level at a date, so its date and name find its own value
    mine = own.select("as_of", "symbol", F.col("pb").alias("opb"), F.col("roe").alias("oroe"))
    nodes_of = levels.select(*NODE, "symbol").join(F.broadcast(sums), NODE).join(F.broadcast(order), NODE)
    df = nodes_of.join(mine, ["as_of", "symbol"], "left").join(
        universe.select("as_of", "symbol", F.col("roe").alias("roe_own")), ["as_of", "symbol"])
    inside = F.col("opb").isNotNull()
    ox, oy = F.coalesce("oroe", F.lit(0.0)), F.coalesce("opb", F.lit(0.0))
    df = df.withColumns({
        "m": F.col("n") - inside.cast("long"), "sx": F.col("sx") - ox, "sy": F.col("sy") - oy,
        "sxx": F.col("sxx") - ox * ox, "sxy": F.col("sxy") - ox * oy, "syy": F.col("syy") - oy * oy,
    })
    m = F.col("m")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / m
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / m
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / m

    def bound(tag: str, p: float) -> Column:
        pos_all, pos_rest = (F.col("n") - 1) * p, (F.col("n") - 2) * p
        a0, a1 = F.col(f"{tag}_all0"), F.coalesce(f"{tag}_all1", f"{tag}_all0")
        whole = a0 + (a1 - a0) * (pos_all - F.floor(pos_all))

        def rest(k: int) -> Column:
            return F.when(F.col(f"{tag}_rest{k}") < F.col("opb"), F.col(f"{tag}_rest{k}")).otherwise(
                F.col(f"{tag}_rest{k + 1}"))

        r0, r1 = rest(0), F.coalesce(rest(1), rest(0))
        return F.when(inside, r0 + (r1 - r0) * (pos_rest - F.floor(pos_rest))).otherwise(whole)

    slope = F.try_divide(cxy, cxx)
    df = df.withColumns({
        "slope": slope, "r2": F.try_divide(cxy * cxy, cxx * cyy),
        "lo": bound("lo", 0.25), "hi": bound("hi", 0.9)})
    df = df.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / m)
    ok = ((m >= 8) & (F.col("slope") > 0) & (F.col("r2") >= 0.10) & F.col("roe_own").isNotNull())
    pred = clip(F.col("intercept") + F.col("slope") * F.col("roe_own"), F.col("lo"), F.col("hi"))
    return df.where(ok).select(
        "as_of", "symbol", m.alias("n_fit"), "slope", "intercept", "r2", pred.alias("pb_target"))
