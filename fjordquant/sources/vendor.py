"""Vendor tables into standard ones: listings, boards, statements, price payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordquant.functions.numeric import lookup
from fjordquant.functions.text import fold

# exchange aliases (fixed values)
EXCHANGES = {"HSX": "HOSE", "HOSE": "HOSE", "HNX": "HNX", "UPCOM": "UPCOM"}
# company kinds: vendor code, then folded keywords by level (fixed values)
TYPE_CODES = {"NH": "BANK", "CK": "SECURITIES", "BH": "INSURANCE"}
KIND_KEYWORDS = [
    ("BANK", ["ngân hàng", "ngan hang", "bank"]),
    ("SECURITIES", ["môi giới chứng khoán", "chứng khoán", "dịch vụ tài chính", "securities",
                    "brokerage"]),
    ("INSURANCE", ["bảo hiểm", "insurance"]),
    ("REAL_ESTATE", ["bất động sản", "bat dong san", "real estate", "phát triển bất động sản"]),
]
FOREIGN_FLOW = "symbol string, time date, buy_volume double, sell_volume double"


# ------------------------------------------------------------------- listings
def security_master(listing: DataFrame) -> DataFrame:
    """Known exchanges, shares only, three-character tickers, one row each."""
    code = F.upper(F.trim("symbol"))
    df = listing.withColumns({"symbol": code, "exchange": lookup(EXCHANGES, F.upper("exchange"))})
    df = df.where((F.upper("type") == "STOCK") & F.col("exchange").isNotNull()
                  & F.col("symbol").rlike("^[A-Z0-9]{3}$"))
    return df.groupBy("symbol").agg(F.min_by(F.struct("exchange", "name"), "ordinal").alias("r")).select(
        "symbol", "r.*")


def flatten_board(raw: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Nested quote-board JSON to dotted columns."""
    parsed = raw.select(F.from_json(column, schema).alias("j"))
    out = []
    for field in parsed.schema["j"].dataType.fields:
        for inner in field.dataType.fields:
            out.append(F.col(f"j.{field.name}.{inner.name}").alias(f"{field.name}.{inner.name}"))
    return parsed.select(*out)


def company_type(code: Column, icb2: Column, icb3: Column, icb4: Column) -> Column:
    """Vendor code first, then folded keywords of the lower industry levels."""
    l2, l3, l4 = (fold(F.coalesce(c, F.lit(""))) for c in (icb2, icb3, icb4))

    def has(c: Column, word: str) -> Column:
        return F.contains(c, F.lit(word))

    by_code = lookup(TYPE_CODES, F.upper(F.coalesce(code, F.lit(""))))
    by_name = (
        F.when(has(l2, "ngan hang") | has(l4, "ngan hang"), "BANK")
        .when(has(l2, "bao hiem") | has(l3, "bao hiem"), "INSURANCE")
        .when(has(l4, "chung khoan"), "SECURITIES")
        .when(has(l2, "bat dong san") & ~has(l4, "dich vu") & ~has(l3, "quy"), "REAL_ESTATE")
        .otherwise("NON_FINANCIAL"))
    return F.coalesce(by_code, by_name)


def classify_by_keywords(df: DataFrame, static: DataFrame) -> DataFrame:
    """Industry keywords in kind order, then the static list, with the reason."""
    text = fold(F.coalesce("industry", F.lit("")))
    kind = F.coalesce(*[
        F.when(F.contains(text, fold(F.lit(k))), F.struct(
            F.lit(name).alias("kind"), F.concat(F.lit("industry: "), F.lit(k)).alias("reason")))
        for name, words in KIND_KEYWORDS for k in words])
    j = df.join(static.withColumnRenamed("kind", "static_kind"), "symbol", "left")
    fallback = F.when(F.col("static_kind").isNotNull(), F.struct(
        F.col("static_kind").alias("kind"), F.lit("static list").alias("reason"))).otherwise(
        F.struct(F.lit("NON_FINANCIAL").alias("kind"), F.lit("default").alias("reason")))
    return j.withColumn("k", F.coalesce(kind, fallback)).select(*df.columns, "k.kind", "k.reason")


def statement_template(kind: Column) -> Column:
    return F.when(kind.isin("BANK", "SECURITIES", "INSURANCE"), kind).otherwise("CORPORATE")


def pivot_levels(levels: DataFrame) -> DataFrame:
    """(symbol, level, code, name) rows to icb1..icb4 with codes."""
    wide = levels.groupBy("symbol").pivot("level", [1, 2, 3, 4]).agg(
        F.first("name").alias("name"), F.first("code").alias("code"))
    return wide.select("symbol", *[F.col(f"{k}_name").alias(f"icb{k}") for k in (1, 2, 3, 4)],
                       *[F.col(f"{k}_code").alias(f"icb{k}_code") for k in (1, 2, 3, 4)])


def price_arrays(payload: DataFrame, zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """Parallel arrays t,o,h,l,c,v to bars; other symbols' answers and null closes drop."""
    ok = payload.where(F.upper("returned_symbol") == F.upper(F.col("symbol").cast("string")))
    rows = ok.select("symbol", F.explode(F.arrays_zip("t", "o", "h", "l", "c", "v")).alias("x"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("x.t"), zone))
    return rows.where(F.col("x.c").isNotNull()).select(
        "symbol", day.alias("time"), F.col("x.o").alias("open"), F.col("x.h").alias("high"),
        F.col("x.l").alias("low"), F.col("x.c").alias("close"), F.col("x.v").alias("volume"))


# ----------------------------------------------------------------- statements
KEYS = ["ticker", "year", "statement", "item_code"]


def combine_statements(files: list[DataFrame]) -> DataFrame:
    """Statement files with their original line order inside (ticker, statement, year)."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("ticker", "statement", "year").orderBy("ordinal")
    return out.withColumn("line_no", F.row_number().over(w) - 1)


def prefer_primary(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """Long rows of both sources; the primary wins per item, never for UPCOM."""
    p = primary.where(F.col("exchange") != "UPCOM").withColumn("source", F.lit(None).cast("string"))
    both = p.unionByName(supplement.withColumn("source", F.lit("supplement")))
    row = F.struct(*[c for c in both.columns if c not in KEYS])
    return both.groupBy(*KEYS).agg(
        F.max_by(row, F.col("source").isNull().cast("int")).alias("r")).select(*KEYS, "r.*")


def wide_statement(long: DataFrame, statement: str, years: list[int]) -> DataFrame:
    """Items by the given years, empty lines dropped, in the newest year's order."""
    rows = long.where((F.col("statement") == statement) & F.col("year").isin(years))
    wide = rows.groupBy("ticker", "item_code").pivot("year", years).agg(F.first("value"))
    order = rows.groupBy("ticker", "item_code").agg(F.max_by("line_no", "year").alias("line_no"))
    filled = F.exists(F.array(*[F.col(str(y)) for y in years]), lambda v: F.coalesce(v, F.lit(0.0)) != 0)
    return wide.where(filled).join(order, ["ticker", "item_code"])


def last_years(df: DataFrame, n: int) -> list[int]:
    """The n newest distinct years, newest first (a few values, whatever the rows)."""
    rows = df.select("year").distinct().orderBy(F.desc("year")).limit(n).collect()
    return [r.year for r in rows]


def coverage(long: DataFrame) -> DataFrame:
    return long.groupBy("ticker").agg(
        F.min_by("exchange", F.struct("year", "exchange")).alias("exchange"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def wide_to_long(wide: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Standard wide rows back to the long schema (field -> item code)."""
    items = F.explode(F.array(*[
        F.struct(F.lit(code).alias("item_code"), F.col(field).alias("value"))
        for field, code in codes.items()]))
    return wide.select(F.col("symbol").alias("ticker"), "year", items.alias("x")).select(
        "ticker", "year", "x.item_code", "x.value").where(F.col("value").isNotNull())


def standardize(long: DataFrame, candidates: dict[str, list[str]],
                zero_is_missing: list[str]) -> DataFrame:
    """Item codes to standard fields by ordered full-match patterns.

    Later candidates fill years the earlier ones lack; a zero counts as missing
    for the listed fields; a last year repeating the year before is dropped.
    """
    rules = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("priority"), F.lit(f"^(?:{p})$").alias("p"))
        for f, ps in candidates.items() for i, p in enumerate(ps)])
    hit = long.withColumn("m", F.explode(F.filter(
        rules, lambda r: F.regexp_like(F.col("item_code"), r["p"])))).select(
        "ticker", "year", "m.field", "m.priority", "value")
    value = F.when(F.col("field").isin(zero_is_missing), F.nullif(F.col("value"), F.lit(0.0))).otherwise(
        F.col("value"))
    best = hit.withColumn("value", value).where(F.col("value").isNotNull()).groupBy(
        "ticker", "year", "field").agg(F.min_by("value", "priority").alias("value"))
    wide = best.groupBy("ticker", "year").pivot("field", list(candidates)).agg(F.first("value"))
    w = Window.partitionBy("ticker").orderBy("year")
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in
            ("total_assets", "revenue", "net_income") if c in candidates]
    last = F.max("year").over(Window.partitionBy("ticker"))
    repeated = F.col("year") == last
    for s in same:
        repeated = repeated & s
    return wide.withColumn("_rep", repeated & (F.lag("year").over(w).isNotNull())).where(
        ~F.col("_rep")).drop("_rep")


def map_item_names(long: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """Item names to fields: the first pattern that hits, then the first matching name."""
    rules = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("no"), F.lit(p).alias("p"))
        for f, ps in patterns.items() for i, p in enumerate(ps)])
    folded = fold(F.col("item_name"))
    hit = long.withColumn("_f", folded).withColumn("m", F.explode(F.filter(
        rules, lambda r: F.regexp_like(F.col("_f"), r["p"]))))
    chosen = hit.groupBy("ticker", "m.field").agg(
        F.min_by("item_name", F.struct("m.no", "row_no")).alias("item_name"))
    vals = long.join(chosen, ["ticker", "item_name"]).groupBy("ticker", "year", "field").agg(
        F.max_by("value", "row_no").alias("value"))
    return vals.groupBy("ticker", "year").pivot("field", list(patterns)).agg(F.first("value"))


def pick_columns(columns: list[str], candidates: dict[str, tuple[list[str], list[str]]]) -> dict[str, str]:
    """Wide vendor column per field: first exact name, else first with all keywords."""
    chosen = {}
    for field, (exact, keywords) in candidates.items():
        names = [c for c in exact if c in columns] or [
            c for c in columns if keywords and all(k in c.lower() for k in keywords)]
        if names:
            chosen[field] = names[0]
    return chosen


def standardize_wide(wide: DataFrame, candidates: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Vendor wide statement to standard fields, last row per year, capex negative."""
    chosen = pick_columns(wide.columns, candidates)
    year = F.regexp_extract(F.col("period").cast("string"), r"((?:19|20)\d{2})", 1)
    fields = [F.expr(f"try_cast(`{c}` AS double)").alias(f) for f, c in chosen.items()]
    rows = wide.select("symbol", "ordinal", F.expr("try_cast(y AS int)").alias("year"), *fields) \
        if "y" in wide.columns else wide.withColumn("y", year).select(
        "symbol", "ordinal", F.expr("try_cast(y AS int)").alias("year"), *fields)
    out = rows.where(F.col("year").isNotNull()).groupBy("symbol", "year").agg(
        F.max_by(F.struct(*chosen), "ordinal").alias("r")).select("symbol", "year", "r.*")
    return out.withColumn("capex", -F.abs("capex")) if "capex" in chosen else out


def latest_publication(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Three statements of a quarter joined; published when the last of them was."""
    keys = ["symbol", "year", "quarter"]

    def newest(df: DataFrame, tag: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in (*keys, "updated_at")])
        return df.where(F.col("quarter").between(1, 4)).groupBy(*keys).agg(
            F.max_by(row, "updated_at").alias("r")).select(*keys, "r.*").withColumnRenamed(
            "published", f"published_{tag}")

    j = newest(income, "i").join(newest(balance, "b"), keys, "full").join(newest(cash, "c"), keys, "full")
    return j.withColumn("published_at", F.greatest("published_i", "published_b", "published_c")).drop(
        "published_i", "published_b", "published_c")


def align_years(profits: DataFrame) -> DataFrame:
    """Detect reversed year labels by the vendor's own growth series.

    ``profits`` has symbol, pos (column position), year label, profit and vendor
    growth; labels flip only when that halves the mean error.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    by_pos = Window.partitionBy("symbol").orderBy("pos")
    by_pos_desc = Window.partitionBy("symbol").orderBy(F.desc("pos"))

    def error(order) -> Column:
        g = F.try_divide(F.col("profit"), F.lag("profit").over(order)) - 1
        return F.when(F.abs("growth") < 10, F.abs(g - F.col("growth")))

    df = profits.withColumns({"n": n, "as_is": error(by_pos), "flip": error(by_pos_desc)})
    means = df.groupBy("symbol").agg(F.avg("as_is").alias("e0"), F.avg("flip").alias("e1"))
    flipped = F.coalesce(F.col("e1") < 0.5 * F.col("e0"), F.lit(False))
    years = profits.select("symbol", F.col("pos").alias("p2"), F.col("year").alias("y2"))
    j = df.join(means.select("symbol", flipped.alias("flipped")), "symbol")
    j = j.withColumn("p2", F.when(F.col("flipped"), F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos")))
    return j.join(years, ["symbol", "p2"]).select(
        "symbol", "pos", F.col("y2").alias("year"), "profit", "flipped")


def first_usable(columns: list[str]) -> Column:
    """First candidate column that holds a number."""
    return F.coalesce(*[F.expr(f"try_cast(`{c}` AS double)") for c in columns])


def reshape_periods(wide: DataFrame, key: str, labels: list[str], order: str,
                    items: list[str] | None = None) -> DataFrame:
    """Item rows with one column per period become period rows with one column per item.

    Lines without any value (headings) go; of lines that repeat an ``item_id`` the last
    stays.  Every column that is no key, label or line number is a period.
    """
    periods = [c for c in wide.columns if c not in (key, "item_id", order, *labels)]
    values = F.struct(*[F.col(c).cast("double").alias(c) for c in periods])
    body = wide.where(F.coalesce(*[F.col(c) for c in periods]).isNotNull()).groupBy(key, "item_id").agg(
        F.max_by(values, order).alias("v")).select(key, "item_id", "v.*")
    long = body.unpivot([key, "item_id"], periods, "period", "value")
    return long.groupBy(key, "period").pivot("item_id", items).agg(F.first("value"))


def fallback_chain(sources: list[tuple[str, DataFrame]], key: str, period: str, n: int = 5) -> DataFrame:
    """Per key all rows of the first source that has any, of these the last ``n`` periods."""
    tagged = [df.withColumns({"priority": F.lit(i), "source": F.lit(name)})
              for i, (name, df) in enumerate(sources)]
    chosen = first_source(reduce(DataFrame.unionByName, tagged), [key]).drop("priority")
    newest = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(period)))
    return chosen.withColumn("_r", newest).where(F.col("_r") <= n).drop("_r")


def coverage_totals(universe: DataFrame, covered: DataFrame, newest_year: Column) -> DataFrame:
    """Statement coverage by exchange and in total (null exchange), in one pass.

    ``universe`` has symbol, exchange and market_cap; ``covered`` has symbol and last_year.
    """
    cap = F.coalesce("market_cap", F.lit(0.0))
    has = F.col("last_year").isNotNull()
    share = lambda part, whole: F.round(100 * F.try_divide(part, whole), 2)
    n, m = F.count(F.lit(1)), F.count("last_year")
    held, total = F.sum(F.when(has, cap).otherwise(0.0)), F.sum(cap)
    return universe.select("symbol", "exchange", "market_cap").join(
        covered.select("symbol", "last_year"), "symbol", "left").withColumn("newest", newest_year).rollup("exchange").agg(
        F.grouping("exchange").alias("is_total"), n.alias("listed"), m.alias("with_statements"),
        share(m, n).alias("coverage_pct"), F.coalesce(share(held, total), F.lit(0.0)).alias("cap_coverage_pct"),
        F.count_if(F.col("last_year") >= F.col("newest")).alias("with_newest"),
        F.count_if(F.col("last_year") < F.col("newest")).alias("only_older"), (n - m).alias("missing"))


def first_source(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the best (lowest) priority that answered, per key."""
    best = rows.groupBy(*by).agg(F.min("priority").alias("priority"))
    return rows.join(best, [*by, "priority"])


def stale(store: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return store.agg((F.date_diff(now, F.max("updated_at")) > days).alias("stale"))
