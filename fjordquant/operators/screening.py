"""Listing pages, searches and small lookups over the universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.functions.text import fold, node_key, words_only

# legal words that never identify a company (fixed values)
LEGAL_WORDS = ["cong", "ty", "co", "phan", "tap", "doan", "ctcp", "jsc", "joint", "stock"]


def universe_page(universe: DataFrame, exchange: str | None = None, node: str | None = None,
                  min_value: float | None = None, q: str | None = None,
                  sort: str = "market_cap", ascending: bool = False, page: int = 1,
                  page_size: int = 50) -> DataFrame:
    """One page of the filtered universe, nulls last."""
    df = universe
    if exchange:
        df = df.where(F.col("exchange").isin([e.strip().upper() for e in exchange.split(",")]))
    if node:
        level = int(node[0])
        df = df.where(node_key(level, F.col(f"icb{level}")) == node)
    if min_value:
        df = df.where(F.coalesce("avg_value_20d", F.lit(0.0)) >= min_value)
    if q:
        df = df.where(F.contains(F.col("symbol").cast("string"), F.lit(q.upper()))
                      | F.contains(F.lower("name"), F.lit(q.lower())))
    order = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    size = max(1, page_size)
    return df.orderBy(order, "symbol").offset((max(1, page) - 1) * size).limit(size)


def symbol_search(universe: DataFrame, query: str, exchange: str = "ALL",
                  limit: int = 2000) -> DataFrame:
    """Ranked matches: code, then brand, then name words, then anywhere."""
    import re
    import unicodedata

    flat = "".join(c for c in unicodedata.normalize("NFD", query)
                   if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    q = re.sub(r"[^a-z0-9]+", " ", flat.lower()).strip()
    if not q:
        return universe.limit(0).select("symbol", F.lit(0).alias("tier"), F.lit(0).alias("rank"))
    compact = q.replace(" ", "")
    df = universe if exchange == "ALL" else universe.where(F.upper("exchange") == exchange.upper())
    code = F.replace(words_only(F.col("symbol").cast("string")), F.lit(" "), F.lit(""))
    brand, name = words_only(F.col("brand")), words_only(F.col("name"))
    words = F.filter(F.split(name, " "), lambda w: ~w.isin(LEGAL_WORDS) & w.startswith(q))
    tier = (
        F.when(code == compact, 0).when(code.startswith(compact), 1)
        .when(F.contains(code, F.lit(compact)), 2)
        .when(F.replace(brand, F.lit(" "), F.lit("")).startswith(compact), 3)
        .when(F.size(words) > 0, 4)
        .when(F.contains(name, F.lit(q)) | F.contains(brand, F.lit(q)), 5))
    hits = df.withColumn("tier", tier).where(F.col("tier").isNotNull())
    if len(compact) <= 3:
        best = hits.agg(F.min("tier")).scalar()
        hits = hits.where((F.col("tier") <= 2) | (best > 2))
    keys = [F.asc("tier"), F.desc("_cap"), F.asc("_code")]
    top = hits.select("symbol", "tier", F.coalesce("market_cap", F.lit(0.0)).alias("_cap"),
                      F.col("symbol").cast("string").alias("_code")).orderBy(*keys).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select(
        "symbol", "tier", "rank")


def nearest_names(securities: DataFrame, typed: str, top: int = 3) -> DataFrame:
    """Closest names by edit distance (at most 1 for short input, else 2)."""
    limit = 1 if len(typed) <= 3 else 2
    distance = F.levenshtein(F.col("name"), F.lit(typed), limit)
    near = securities.select("symbol", "name", distance.alias("distance")).where(
        F.col("distance") >= 0).orderBy("distance", "name").limit(top)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "name")))


def industry_of(symbols: DataFrame, securities: DataFrame, column: str = "icb3",
                default: str = "Khac") -> DataFrame:
    return symbols.join(securities.select("symbol", column), "symbol", "left").select(
        "symbol", F.coalesce(column, F.lit(default)).alias("industry"))


def rebased_lines(bars: DataFrame, symbols: list, days: int = 365) -> DataFrame:
    """Closes of a few symbols over the last days, rebased to 100, side by side."""
    chosen = bars.where(F.col("symbol").isin(symbols))
    last = chosen.agg(F.max("time")).scalar()
    recent = chosen.where(F.col("time") > F.date_sub(last, days))
    w = Window.partitionBy("symbol").orderBy("time")
    return recent.withColumn("v", F.col("close") / F.first("close").over(w) * 100).groupBy(
        "time").pivot("symbol", symbols).agg(F.first("v"))


def industry_peers(universe: DataFrame, column: str, k: int) -> DataFrame:
    """The k most traded other members of each symbol's industry.

    k others are always among the industry's k+1 most traded, so only those are
    joined to the members.
    """
    order = Window.partitionBy(column).orderBy(F.desc_nulls_last("avg_value_20d"), "symbol")
    top = universe.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select(
        column, F.col("symbol").alias("peer"), "_r")
    own = Window.partitionBy("symbol").orderBy("_r")
    return universe.select("symbol", column).join(top, column).where(
        F.col("symbol") != F.col("peer")).withColumn("rank", F.row_number().over(own)).where(
        F.col("rank") <= k).select("symbol", "peer", "rank")


def column_filter(column: Column, text: str) -> Column:
    """The table filter box: ``>x >=x <x <=x =x a..b`` on numbers, else contains."""
    import re

    t = text.strip()
    number = r"-?\d+(?:\.\d+)?"
    if m := re.fullmatch(rf"({number})\s*\.\.\s*({number})", t):
        return column.between(float(m[1]), float(m[2]))
    if m := re.fullmatch(rf"(>=|<=|>|<|=)\s*({number})", t):
        v = F.lit(float(m[2]))
        return {">": column > v, ">=": column >= v, "<": column < v, "<=": column <= v,
                "=": column == v}[m[1]]
    return F.contains(fold(column.cast("string")), fold(F.lit(t)))
