"""Ratios, growth, statement pages and the checks on statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.functions.numeric import change, ratio, zero


def _by_year():
    return Window.partitionBy("symbol").orderBy("year")


def _has(c: str) -> Column:
    """Whether the symbol reports this field at all."""
    return F.count(c).over(Window.partitionBy("symbol")) > 0


def average(c: Column | str) -> Column:
    """Mean of opening and closing value, the closing one in the first year."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c + F.lag(c).over(_by_year())) / 2, c)


def growth(c: str) -> Column:
    return ratio(F.col(c), F.lag(c).over(_by_year())) - 1


BANK_RATIOS = ["nim", "cir", "credit_cost", "ldr", "equity_to_assets", "loan_growth", "toi_growth"]
COMPANY_RATIOS = [
    "gross_margin", "operating_margin", "net_margin", "revenue_growth", "asset_turnover",
    "debt_to_equity", "liabilities_to_assets", "current_ratio", "quick_ratio",
    "interest_coverage", "inventory_days", "cfo_to_ni", "fcf",
]
COMMON_RATIOS = ["roe", "roa", "ni_growth"]
ALL_RATIOS = COMMON_RATIOS + BANK_RATIOS + COMPANY_RATIOS


def annual_ratios(annual: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All ratios of every (symbol, year); ``annual`` carries ``company_type``.

    ``keep`` passes statement fields through, which saves joining them back.

    One window spec serves every ratio, so the frame is sorted once.
    """
    df = annual.withColumns({
        "nip": F.when(_has("net_income_parent"), F.col("net_income_parent"))
        .otherwise(F.col("net_income")),
        "ni_any": F.when(_has("net_income"), F.col("net_income"))
        .otherwise(F.col("net_income_parent")),
        "eq_parent": F.col("equity") - zero("minority_interest"),
        "debt": zero("short_debt") + zero("long_debt"),
    })
    prev = F.lag("nip").over(_by_year())
    bank = F.col("company_type") == "BANK"
    banks = {
        "nim": ratio("net_interest_income", average("total_assets")),
        "cir": ratio(F.abs("operating_expense"), "total_operating_income"),
        "credit_cost": ratio(F.abs("provision"), average("loans")),
        "ldr": ratio("loans", "deposits"),
        "equity_to_assets": ratio("equity", "total_assets"),
        "loan_growth": growth("loans"),
        "toi_growth": growth("total_operating_income"),
    }
    ebit = F.when(_has("pbt"), F.col("pbt") + F.abs("interest_expense")).otherwise(
        F.col("operating_profit"))
    others = {
        "gross_margin": ratio("gross_profit", "revenue"),
        "operating_margin": ratio("operating_profit", "revenue"),
        "net_margin": ratio("ni_any", "revenue"),
        "revenue_growth": growth("revenue"),
        "asset_turnover": ratio("revenue", average("total_assets")),
        "debt_to_equity": ratio("debt", "equity"),
        "liabilities_to_assets": ratio("total_liabilities", "total_assets"),
        "current_ratio": ratio("current_assets", "current_liabilities"),
        "quick_ratio": ratio(F.col("current_assets") - F.col("inventory"), "current_liabilities"),
        "interest_coverage": ratio(ebit, F.abs("interest_expense")),
        "inventory_days": ratio(average("inventory"), F.abs("cogs")) * 365,
        "cfo_to_ni": ratio("cfo", "ni_any"),
        "fcf": F.col("cfo") + F.col("capex"),
    }
    return df.select(
        "symbol", "company_type", "year",
        ratio("nip", average("eq_parent")).alias("roe"),
        ratio("ni_any", average("total_assets")).alias("roa"),
        F.when(prev > 0, F.col("nip") / prev - 1).alias("ni_growth"),
        *[F.when(bank, c).alias(k) for k, c in banks.items()],
        *[F.when(~bank, c).alias(k) for k, c in others.items()], *keep)


def cagr(first: Column, last: Column, years: Column) -> Column:
    ok = (first > 0) & (last > 0)
    return F.when(ok, F.pow(last / first, 1.0 / F.greatest(years, F.lit(1))) - 1)


def growth_summary(annual: DataFrame) -> DataFrame:
    """CAGR of the top line and of parent profit between first and last known year."""
    top = F.when(F.col("company_type") == "BANK", F.col("total_operating_income")).otherwise(
        F.col("revenue"))
    df = annual.withColumn("top", top)

    def span(c: str) -> Column:
        y = F.when(F.col(c).isNotNull(), F.col("year"))
        return F.when(F.count(c) >= 2, cagr(
            F.min_by(c, y), F.max_by(c, y), F.max(y) - F.min(y)))

    return df.groupBy("symbol", "company_type").agg(
        span("top").alias("top_line_cagr"), span("net_income_parent").alias("ni_cagr"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year")).withColumn(
        "top_line_label",
        F.when(F.col("company_type") == "BANK", "Tổng thu nhập hoạt động")
        .otherwise("Doanh thu thuần"))


def fill_derived(annual: DataFrame) -> DataFrame:
    """Fields a source does not report, computed and tagged."""
    rules = {
        "net_income_parent": F.col("net_income"),
        "cogs": F.col("gross_profit") - F.col("revenue"),
        "total_liabilities": F.col("total_assets") - F.col("equity"),
    }
    missing = {c: ~_has(c) & F.max(rule.isNotNull()).over(Window.partitionBy("symbol"))
               for c, rule in rules.items()}
    tags = F.array_join(F.array_compact(F.array(*[
        F.when(m, F.lit(c)) for c, m in missing.items()])), ",")
    df = annual.withColumn("computed", tags)
    return df.withColumns({c: F.coalesce(F.col(c), F.when(F.contains(F.concat(
        F.lit(","), "computed", F.lit(",")), F.lit(f",{c},")), rule)) for c, rule in rules.items()})


# base line and key lines of each statement page (fixed values)
PAGES = {
    "is": ("revenue", ["revenue", "cogs", "gross_profit", "operating_profit", "pbt",
                       "net_income", "net_income_parent"]),
    "bs": ("total_assets", ["cash", "inventory", "current_assets", "total_assets",
                            "total_liabilities", "equity"]),
    "cf": ("cfo", ["cfo", "capex"]),
}


def statement_page(annual: DataFrame, statement: str, years: int = 5) -> DataFrame:
    """Values, share of the base line, yearly change, in key-line order."""
    base, lines = PAGES[statement]
    newest = Window.partitionBy("symbol").orderBy(F.desc("year"))
    df = annual.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= years)
    df = df.withColumns({f"_prev_{c}": F.lag(c).over(_by_year()) for c in lines})
    items = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("line"), F.col(c).alias("value"),
                 F.col(f"_prev_{c}").alias("prev")) for i, c in enumerate(lines)]))
    df = df.select("symbol", "year", F.col(base).alias("base"), items.alias("x"))
    return df.select(
        "symbol", "year", "x.rank", "x.line", "x.value",
        ratio("x.value", "base").alias("common_size"), change("x.value", "x.prev").alias("yoy"))


def latest_quarters(rows: DataFrame, n: int = 8) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("year"), F.desc("quarter"))
    return rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def validate_quarters(rows: DataFrame) -> DataFrame:
    """Accept or reject each quarter: the balance must close and be plausible."""
    gap = F.abs(F.col("total_assets") - F.col("total_liabilities") - F.col("equity"))
    reason = (
        F.when(F.col("total_assets").isNull() | F.col("equity").isNull(), "missing")
        .when(gap / F.greatest(F.abs("total_assets"), F.lit(1e-9)) > 0.01, "balance")
        .when(F.col("total_assets") < 1e9, "unit"))
    return rows.withColumn("rejected", reason)


def validate_annual(annual: DataFrame) -> DataFrame:
    """Per symbol: enough periods, balance gap, size and the required top line."""
    gap = F.abs(F.col("total_assets") - F.col("total_liabilities") - F.col("equity")) / F.col(
        "total_assets")
    top = F.when(F.col("company_type") == "BANK", F.col("net_interest_income")).otherwise(
        F.col("revenue"))
    per = annual.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("periods"), F.max(gap).alias("max_gap"),
        F.median("total_assets").alias("median_assets"), F.count(top).alias("n_top"))
    return per.withColumn("error", F.when(F.col("periods") < 5, "periods")
                          .when(F.col("max_gap") > 0.01, "balance")
                          .when(F.col("median_assets") < 1e9, "unit")
                          .when(F.col("n_top") == 0, "top_line"))
