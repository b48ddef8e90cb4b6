"""Valuation of every (as_of, symbol) at once.

``annual_features`` turns the yearly statements into one row per (symbol, year)
that already holds everything a valuation needs from the years before it, so
valuing at any date is an as-of pick of one row, without per-symbol code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip, hundred, lookup, zero
from fjordquant.functions.ordering import sorted_quantile
from fjordquant.operators.statements import annual_ratios, cagr

HISTORY_YEARS = 6
SCENARIOS = ("bear", "base", "bull")
STATEMENT_KEEP = (
    "revenue", "gross_profit", "total_operating_income", "net_income", "net_income_parent",
    "equity", "minority_interest", "total_assets", "total_liabilities", "pbt",
    "interest_expense", "depreciation", "short_debt", "long_debt", "cash", "short_investments",
    "cfo", "capex",
)


def tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def december_closes(bars: DataFrame) -> DataFrame:
    return bars.where(F.month("time") == 12).groupBy(
        "symbol", F.year("time").alias("year")).agg(F.max_by("close", "time").alias("dec_close"))


def annual_features(annual: DataFrame, december: DataFrame) -> DataFrame:
    """Per (symbol, year): that year's statement, ratios and trailing figures."""
    df = annual_ratios(annual, STATEMENT_KEEP).join(december, ["symbol", "year"], "left")
    order = Window.partitionBy("symbol").orderBy("year")
    w6, w5, w2 = (order.rowsBetween(-k, 0) for k in (HISTORY_YEARS - 1, 4, 1))
    top = F.when(F.col("company_type") == "BANK", F.col("total_operating_income")).otherwise(
        F.col("revenue"))
    fcff = F.col("cfo") + F.col("capex") + F.abs(zero("interest_expense")) * (1 - S.TAX)
    df = df.withColumns({
        "top": top, "fcff": fcff, "debt": zero("short_debt") + zero("long_debt"),
        "eq_parent": F.col("equity") - zero("minority_interest"),
        "_gap": F.abs(F.col("total_liabilities") + F.col("equity") - F.col("total_assets"))
        / F.greatest(F.abs("total_assets"), F.lit(1e-9)),
    })

    def span(c: str, least: int) -> Column:
        y = F.when(F.col(c).isNotNull(), F.col("year"))
        rate = cagr(F.first(c, ignorenulls=True).over(w6), F.last(c, ignorenulls=True).over(w6),
                    F.last(y, ignorenulls=True).over(w6) - F.first(y, ignorenulls=True).over(w6))
        return F.when(F.count(c).over(w6) >= least, rate)

    past = F.collect_list(F.struct(
        F.col("dec_close").alias("c"), F.col("net_income_parent").alias("ni"),
        F.col("eq_parent").alias("eq"))).over(w5)
    bad = (F.col("_gap") > 0.01) | (
        (F.col("company_type") != "BANK") & (F.col("gross_profit") > F.col("revenue") * 1.001))
    return df.withColumns({
        "g_raw": span("net_income_parent", 3), "ni_cagr": span("net_income_parent", 2),
        "top_line_cagr": span("top", 2),
        "fcff3": array_mean(tail(F.collect_list("fcff").over(w6), 3)),
        "avg_debt": F.avg("debt").over(w2),
        "interest": F.abs(F.last("interest_expense", ignorenulls=True).over(w6)),
        "roe3": array_mean(tail(F.collect_list("roe").over(w6), 3)),
        "cfo_to_ni3": array_mean(tail(F.collect_list("cfo_to_ni").over(w6), 3)),
        "n_years": F.count(F.lit(1)).over(w6),
        "failed_checks": F.sum(F.coalesce(bad, F.lit(False)).cast("int")).over(w6),
        "past": past,
        "visible_from": F.make_date(F.col("year") + 1, F.lit(S.ANNUAL_VISIBLE[0]),
                                    F.lit(S.ANNUAL_VISIBLE[1])),
    }).drop("_gap")


def historical_multiples(df: DataFrame) -> DataFrame:
    """Own P/E and P/B at the Decembers of the last five years, current shares."""
    def ratios(den: str, keep) -> Column:
        usable = F.filter("past", lambda x: (x[den] > 0) & x["c"].isNotNull())
        return F.sort_array(F.filter(
            F.transform(usable, lambda x: x["c"] * F.col("shares") / x[den]), keep))

    df = df.withColumns({
        "_hpe": ratios("ni", lambda m: m < 60), "_hpb": ratios("eq", lambda m: m <= 20)})
    out = {}
    for k in ("pe", "pb"):
        for tag, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            out[f"hist_{k}_{tag}"] = F.when(
                F.size(f"_h{k}") >= 3, sorted_quantile(F.col(f"_h{k}"), p))
    return df.withColumns(out).drop("_hpe", "_hpb")


def cost_of_equity(beta: Column, rf: Column | float = S.RISK_FREE) -> Column:
    b = clip(F.coalesce(beta, F.lit(S.DEFAULT_BETA)), *S.BETA_RANGE)
    return F.greatest(F.lit(rf) + b * S.EQUITY_PREMIUM, F.lit(S.KE_FLOOR))


def _triplet(df: DataFrame, key: str, current: str) -> DataFrame:
    """Peer multiples, or the own history when the peers do not fit or are missing."""
    peers = [F.col(f"{key}_{t}") for t in ("p25", "p50", "p75")]
    own = [F.col(f"hist_{key}_{t}") for t in ("p25", "p50", "p75")]
    median = F.col(f"{key}_p50")
    apart = ((median != 0) & F.col(current).isNotNull()
             & ~(F.col(current) / median).between(0.25, 4.0))
    usable = (peers[0] > 0) & (peers[1] > 0) & (peers[2] > 0)
    own_ok = (own[0] > 0) & (own[1] > 0) & (own[2] > 0)
    take_peers = ~F.coalesce(apart, F.lit(False)) & F.coalesce(usable, F.lit(False))
    df = df.withColumn(f"{key}_source", F.when(take_peers, "peers").when(own_ok, "history"))
    return df.withColumns({
        f"{key}_m{i}": F.when(F.col(f"{key}_source") == "peers", peers[i])
        .when(F.col(f"{key}_source") == "history", own[i]) for i in range(3)})


def _dcf_value(wacc: Column, g: Column) -> Column:
    """Five fading years of FCFF and the terminal value, per share."""
    gt, n = S.TERMINAL_GROWTH, S.DCF_YEARS
    pv, f = F.lit(0.0), F.col("fcff3")
    for year in range(1, n + 1):  # plain terms, as a fold over an array is not compiled
        t = F.lit(float(year))
        f = f * (1 + g + (gt - g) * (t - 1) / (n - 1))
        pv = pv + f / F.pow(1 + wacc, t)
    terminal = f * (1 + gt) / (wacc - gt)
    ev = pv + terminal / F.pow(1 + wacc, F.lit(float(n)))
    net = F.col("debt") - zero("cash") - zero("short_investments") + zero("minority_interest")
    return F.when(wacc > gt + 0.01, (ev - net) / F.col("shares"))


def methods(df: DataFrame) -> DataFrame:
    """All method values of a joined row (price, shares, features, peers, beta).

    Rows of special multi-industry groups set ``special`` true: they use no peer
    multiples, no EV/EBITDA and no DCF.
    """
    special = F.coalesce("special", F.lit(False)) if "special" in df.columns else F.lit(False)
    df = df.withColumns({
        "ke": cost_of_equity(F.col("beta")),
        "nip": F.coalesce("ni_ttm", "net_income_parent", "net_income"),
        "eq_parent": F.when(F.col("equity") != 0, F.col("equity") - zero("minority_interest")),
        "growth": clip(F.coalesce("g_raw", F.lit(S.DEFAULT_GROWTH)), *S.GROWTH_RANGE),
    })
    cap = F.col("price") * F.col("shares")
    df = df.withColumns({
        "valued": (F.col("shares") != 0) & (F.col("price") != 0) & F.col("year").isNotNull(),
        "eps": F.col("nip") / F.col("shares"),
        "bvps": F.when(F.col("eq_parent") != 0, F.col("eq_parent") / F.col("shares")),
        "current_pe": F.when(F.col("nip") > 0, cap / F.col("nip")),
        "current_pb": F.when(F.col("eq_parent") > 0, cap / F.col("eq_parent")),
    })
    df = _triplet(df, "pe", "current_pe")
    df = df.withColumns({
        "_pbt": F.coalesce("pb_target", "pb_p50"),
        "_pb75": F.when(F.col("pb_target").isNotNull(), F.greatest("pb_target", "pb_p75"))
        .otherwise(F.col("pb_p75")),
    }).withColumns({"pb_p50": F.col("_pbt"), "pb_p75": F.col("_pb75")}).drop("_pbt", "_pb75")
    df = _triplet(df, "pb", "current_pb")
    fwd = F.col("eps") * (1 + F.col("growth"))
    pe_ok = F.col("valued") & ~special & (F.col("current_pe") < 60) & (F.col("eps") > 0)
    cap90 = F.greatest(F.col("pb_m0"), F.coalesce("pb_p90", "pb_m2"))
    pb = [F.col("pb_m0"), F.least(cap90, F.greatest("pb_m0", "pb_m1")), cap90]
    pb_ok = F.col("valued") & (F.col("bvps") > 0) & F.col("pb_source").isNotNull()
    wd = F.try_divide(F.col("debt"), F.col("debt") + cap)
    kd = F.when((F.col("debt") != 0) & (F.col("avg_debt") != 0) & F.col("interest").isNotNull(),
                clip(F.col("interest") / F.col("avg_debt"), *S.KD_RANGE)).otherwise(S.DEFAULT_KD)
    df = df.withColumns({"kd": kd, "wd": wd})
    df = df.withColumn("wacc", (1 - F.col("wd")) * F.col("ke") + F.col("wd") * F.col("kd") * (1 - S.TAX))
    dcf_ok = (F.col("valued") & ~special & (F.col("company_type") == "NON_FINANCIAL")
              & (F.col("fcff3") > 0))
    dcf = [(0.01, -0.02), (0.0, 0.0), (-0.01, 0.02)]
    gs = F.least(clip(F.col("roe3") * 0.75, F.lit(0.0), F.col("ke") - 0.02),
                 F.lit(S.BANK_G_CAP), F.col("ke") - 0.04)
    df = df.withColumn("bank_g", gs)
    bank_ok = F.col("valued") & (F.col("company_type") == "BANK") & F.col("roe3").isNotNull()
    ebitda = F.col("pbt") + F.abs(zero("interest_expense")) + F.abs(F.col("depreciation"))
    ev_ok = (F.col("valued") & ~special & (F.col("company_type") == "NON_FINANCIAL") & (ebitda > 0)
             & (F.col("ev_p25") > 0) & (F.col("ev_p50") > 0) & (F.col("ev_p75") > 0))
    net = -F.col("debt") + zero("cash") + zero("short_investments") - zero("minority_interest")

    def gordon(shift: float) -> Column:
        return F.col("bvps") * clip(
            (F.col("roe3") + shift - F.col("bank_g")) / (F.col("ke") - F.col("bank_g")), 0.3, 4.0)

    values = {}
    for i, sc in enumerate(SCENARIOS):
        values[f"pe_relative_{sc}"] = F.when(pe_ok, fwd * F.col(f"pe_m{i}"))
        values[f"pb_relative_{sc}"] = F.when(pb_ok, F.col("bvps") * pb[i])
        values[f"ev_ebitda_{sc}"] = F.when(
            ev_ok, (ebitda * F.col(f"ev_p{('25', '50', '75')[i]}") + net) / F.col("shares"))
        dw, dg = dcf[i]
        values[f"dcf_fcff_{sc}"] = F.when(
            dcf_ok, _dcf_value(F.col("wacc") + dw, F.col("growth") + dg))
        values[f"justified_pb_{sc}"] = F.when(bank_ok, gordon((-0.02, 0.0, 0.02)[i]))
    return df.withColumns(values)


METHODS = ("pe_relative", "pb_relative", "ev_ebitda", "dcf_fcff", "justified_pb")


def blend(df: DataFrame) -> DataFrame:
    """Weights, outlier rule, target prices, upside and confidence."""
    # a column for each method, as functions over short arrays are not compiled
    good = {}
    for m in METHODS:
        weight = lookup({t: w[m] for t, w in S.METHOD_WEIGHTS.items() if m in w},
                        F.col("company_type"))
        vals = [F.col(f"{m}_{sc}") for sc in SCENARIOS]
        good[f"_w_{m}"] = F.when(
            (weight > 0) & (vals[0] > 0) & (vals[1] > 0) & (vals[2] > 0), weight)
    df = df.withColumns(good)

    def over(start: Column, term, missing: Column) -> Column:
        total = start
        for m in METHODS:
            total = total + F.when(F.col(f"_w_{m}").isNotNull(), term(m)).otherwise(missing)
        return total

    def counted() -> Column:
        return over(F.lit(0), lambda m: F.lit(1), F.lit(0))

    # missing values sort to the front
    df = df.withColumns({"_n": counted(), "_b": F.sort_array(F.array(*[
        F.when(F.col(f"_w_{m}").isNotNull(), F.col(f"{m}_base")) for m in METHODS]))})
    pos, skip = (F.col("_n") - 1) * F.lit(0.5), len(METHODS) - F.col("_n")
    low, high = (F.get("_b", skip + k(pos).cast("int")) for k in (F.floor, F.ceil))
    df = df.withColumn("_med", F.when(F.col("_n") > 0, low + (high - low) * (pos - F.floor(pos))))
    near = {m: F.col(f"{m}_base").between(F.col("_med") / 2.5, F.col("_med") * 2.5) for m in METHODS}
    df = df.withColumns({
        f"_w_{m}": F.when((F.col("_n") < 3) | near[m], F.col(f"_w_{m}")) for m in METHODS})
    zero_sum = F.lit(0.0)
    df = df.withColumns({
        "_mass": over(zero_sum, lambda m: F.col(f"_w_{m}"), zero_sum), "n_methods": counted()})

    def target(sc: str) -> Column:
        total = over(zero_sum, lambda m: F.col(f"{m}_{sc}") * F.col(f"_w_{m}") / F.col("_mass"), zero_sum)
        return F.when(F.col("n_methods") > 0, hundred(total))

    df = df.withColumns({f"target_{sc}": target(sc) for sc in SCENARIOS})
    bases = [F.when(F.col(f"_w_{m}").isNotNull(), F.col(f"{m}_base")) for m in METHODS]
    usable = F.array_compact(F.array(*[F.when(F.col(f"_w_{m}").isNotNull(), F.struct(
        F.lit(m).alias("key"), F.col(f"_w_{m}").alias("w"),
        *[F.col(f"{m}_{sc}").alias(sc) for sc in SCENARIOS])) for m in METHODS]))
    df = df.withColumn("usable", usable).withColumns({
        "upside": F.col("target_base") / F.col("price") - 1,
        "dispersion": F.when(F.col("n_methods") >= 2, F.greatest(*bases) / F.least(*bases)),
        "method_weights": F.map_from_entries(F.transform(
            "usable", lambda x: F.struct(x["key"], x["w"] / F.col("_mass")))),
    })
    outside = ~F.col("upside").between(-0.5, 1.0)
    low = (F.col("n_methods") <= 1) | (F.col("dispersion") > 2.5) | outside
    reason = F.concat_ws(
        "; ",
        F.concat(F.col("n_methods").cast("string"), F.lit(" phương pháp hợp lệ")),
        F.concat(F.lit("phân tán tối đa/tối thiểu "), F.format_string("%.2f", "dispersion"),
                 F.lit("x")),
        F.when(outside, "upside ngoài dải −50% đến +100%"))
    return df.withColumns({
        "confidence": F.when(F.coalesce(low, F.lit(False)), S.LOW)
        .when(F.col("n_methods") == 2, S.MEDIUM).otherwise(S.HIGH),
        "confidence_reason": reason,
    }).drop("_n", "_b", "_med", "_mass", *[f"_w_{m}" for m in METHODS])


def sensitivity(df: DataFrame, pe_grid: list[float], pb_grid: list[float],
                ke_grid: list[float], g_grid: list[float]) -> DataFrame:
    """Re-price every symbol on a grid of user assumptions (fixed, small grid)."""
    grid = F.array(*[
        F.struct(F.lit(a).alias("pe_in"), F.lit(b).alias("pb_in"), F.lit(k).alias("ke_in"),
                 F.lit(g).alias("g_in"))
        for a in pe_grid for b in pb_grid for k in ke_grid for g in g_grid])
    x = df.withColumn("s", F.explode(grid)).select("*", "s.*").drop("s")
    fair = F.when(F.col("ke_in") > F.col("g_in"), F.col("bvps") * (
        F.col("roe") - F.col("g_in")) / (F.col("ke_in") - F.col("g_in")))
    return x.withColumns({
        "price_pe": F.when(F.col("eps") > 0, F.col("eps") * F.col("pe_in")),
        "price_pb": F.when(F.col("bvps") > 0, F.col("bvps") * F.col("pb_in")),
        "price_gordon": fair,
    })
