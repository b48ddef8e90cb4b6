"""Technical state, score, action and wording, per bar for all symbols.

The state of a bar depends on the bars up to it only, so one pass gives the
state at every date; callers keep the rows they need (the last bar of each
symbol, or the bars of the signal dates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip
from fjordquant.operators import indicators as I
from fjordquant.operators.state_arrays import states_at


def up_to_now() -> WindowSpec:
    return I.by_pos().rowsBetween(Window.unboundedPreceding, 0)


def _cross(df: DataFrame, name: str, fast: str, slow: str) -> DataFrame:
    """Latest sign change of fast - slow up to each bar: direction and age."""
    sign = F.signum(F.col(fast) - F.col(slow))
    df = df.withColumn(f"_sg_{name}", sign)
    before = F.lag(f"_sg_{name}").over(I.by_pos())
    df = df.withColumn(
        f"_ch_{name}", F.when(F.col(f"_sg_{name}") != before, F.col("i"))
    )
    at = F.max(f"_ch_{name}").over(up_to_now())
    direction = F.last(
        F.when(F.col(f"_ch_{name}").isNotNull(), F.when(F.col(f"_sg_{name}") > 0, "golden")
               .otherwise("death")), ignorenulls=True,
    ).over(up_to_now())
    return df.withColumns({
        f"{name}_cross": direction, f"{name}_cross_at": at, f"{name}_bars": F.col("i") - at,
    })


def _nearest(points: Column, at: Column, tolerance: int) -> Column:
    """Value of the point closest to ``at`` (the earlier one on a tie)."""
    near = F.filter(points, lambda p: F.abs(p["i"] - at) <= tolerance)
    best = F.array_min(F.transform(
        near, lambda p: F.struct(F.abs(p["i"] - at).alias("d"), p["i"].alias("i"),
                                 p["v"].alias("v"))))
    return best["v"]


def with_swing_lists(df: DataFrame, oscillator: str = "hist", lookback: int = 60,
                     order: int = 5) -> DataFrame:
    """Swing points of price and oscillator in the last bars, as short lists.

    The lists of one bar hold at most lookback/(order+1) points.
    """
    df = df.withColumns({"_ps": I.swing("close", order), "_os": I.swing(oscillator, order)})
    frame = I.by_pos().rowsBetween(-(lookback - 1 - order), -order)

    def points(kind: str, value: str, side: str) -> Column:
        return F.collect_list(F.when(
            F.col(kind) == side, F.struct(F.col("i").alias("i"), F.col(value).alias("v"))
        )).over(frame)

    return df.withColumns({
        "_pl": points("_ps", "close", "L"), "_ph": points("_ps", "close", "H"),
        "_ol": points("_os", oscillator, "L"), "_oh": points("_os", oscillator, "H"),
    })


def with_divergence(df: DataFrame, order: int = 5) -> DataFrame:
    """Bullish/bearish divergence of price and oscillator from the swing lists."""

    def pair(name: str):
        first = F.when(F.size(name) >= 2, F.element_at(name, -2))
        second = F.when(F.size(name) >= 2, F.element_at(name, -1))
        return first, second

    l1, l2 = pair("_pl")
    h1, h2 = pair("_ph")
    tol = 2 * order
    ol1, ol2 = _nearest(F.col("_ol"), l1["i"], tol), _nearest(F.col("_ol"), l2["i"], tol)
    oh1, oh2 = _nearest(F.col("_oh"), h1["i"], tol), _nearest(F.col("_oh"), h2["i"], tol)
    df = df.withColumns({"_a": ol1, "_b": ol2, "_c": oh1, "_d": oh2})
    bullish = (l2["v"] < l1["v"]) & (F.col("_b") > F.col("_a"))
    bearish = (h2["v"] > h1["v"]) & (F.col("_d") < F.col("_c"))

    def strength(first: str, second: str) -> Column:
        base = F.when(F.col(first) == 0, 1.0).otherwise(F.abs(F.col(first)))
        return F.abs(F.col(second) - F.col(first)) / base

    return df.withColumns({
        "divergence": F.when(bullish, "bullish").when(bearish, "bearish"),
        "divergence_strength": F.when(bullish, strength("_a", "_b"))
        .when(bearish, strength("_c", "_d")).otherwise(0.0),
    }).drop("_ps", "_os", "_pl", "_ph", "_ol", "_oh", "_a", "_b", "_c", "_d")


def technical_state(bars: DataFrame, preset: str = "six_day_week", shift: int = 26,
                    wanted: DataFrame | str | None = None) -> DataFrame:
    """Every indicator and state column per bar.

    ``wanted`` keeps only some bars: "last" for the newest of each symbol, or a
    table of (symbol, time).  The bars of a table come from arrays, as nearly all of
    the time goes into frames that the other bars do not need.  Otherwise all windows
    run first, then the unwanted bars drop, so the per-row array work is done for
    wanted bars only.
    """
    if isinstance(wanted, DataFrame):
        return _described(states_at(bars, wanted, preset, shift), shift)
    df = I.ichimoku(I.oscillators(bars), preset, shift)
    df = I.with_rsi_window(df)
    df = _cross(df, "macd", "macd", "signal")
    df = _cross(df, "tk", "tenkan", "kijun")
    df = _cross(df, "base", "base_a", "base_b")
    df = df.withColumn("zone", I.cloud_zone(F.col("close"), F.col("senkou_a"), F.col("senkou_b")))
    df = df.withColumn("_zs", F.when(
        F.col("zone").isNotNull()
        & ~F.lag("zone").over(I.by_pos()).eqNullSafe(F.col("zone")), F.col("i")))
    df = df.withColumns({
        "_started": F.max("_zs").over(up_to_now()), "_seen": F.count("zone").over(up_to_now()),
        "_back": F.lag("close", shift).over(I.by_pos()),
        "_avg_volume": I.guarded(F.avg("volume"), "volume", 20, I.by_pos()),
        "hist_slope": I.slope("hist", 3), "rsi_slope": I.slope("rsi", 5),
    })
    df = with_swing_lists(df)
    if isinstance(wanted, str):
        df = df.withColumn("_want", F.lead("i").over(I.by_pos()).isNull())
        df = df.where("_want").drop("_want")
    return with_divergence(_described(I.with_band_levels(df), shift))


def _described(df: DataFrame, shift: int) -> DataFrame:
    """The state columns that follow from the other columns of the same bar."""
    inside = F.col("zone").isNotNull()
    df = df.withColumns({
        "volume_ratio": F.col("volume") / F.col("_avg_volume"),
        "above_zero": F.col("macd") > 0,
        "upper": F.when(F.col("rsi").isNotNull(), F.coalesce("upper", F.lit(S.RSI_UPPER[1]))),
        "lower": F.when(F.col("rsi").isNotNull(), F.coalesce("lower", F.lit(S.RSI_LOWER[0]))),
        "twist": F.when(inside, F.coalesce(
            F.col("base_cross_at") - 1 >= F.col("i") - (shift - 1), F.lit(False))),
        "chikou_free": F.when(inside, F.col("close") > F.col("_back")),
        "thickness": F.when(
            F.col("atr") != 0, F.abs(F.col("senkou_a") - F.col("senkou_b")) / F.col("atr")),
        "break_bars": F.when(
            (F.col("zone") != "trong_may") & (F.col("_seen") >= 2), F.col("i") - F.col("_started")),
        "tk_cross": F.when(inside, F.col("tk_cross")),
        "tk_bars": F.when(inside, F.col("tk_bars")),
    })
    return df.withColumns({
        "rsi_zone": F.when(
            F.col("rsi").isNotNull(),
            F.when(F.col("rsi") > F.col("upper"), "qua_mua")
            .when(F.col("rsi") < F.col("lower"), "qua_ban").otherwise("trung_tinh")),
        "tk_strength": F.when(
            F.col("tk_cross").isNotNull(),
            F.when(F.col("zone") == "tren_may", "manh")
            .when(F.col("zone") == "trong_may", "trung_tinh").otherwise("yeu")),
    })


def _decay(bars: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - bars / 20.0)


def with_scores(df: DataFrame) -> DataFrame:
    """Component scores in [-100, 100] and their weighted total."""
    above = F.col("above_zero")
    bonus = (
        F.when(F.col("macd_cross") == "golden", F.when(above, 45.0).otherwise(30.0))
        .when(F.col("macd_cross") == "death", F.when(above, -30.0).otherwise(-45.0))
    )
    macd = (
        F.when(above, 35.0).otherwise(-35.0)
        + F.coalesce(bonus * _decay(F.col("macd_bars")), F.lit(0.0))
        + F.coalesce(clip(F.col("hist_slope") * 200.0, -15.0, 15.0), F.lit(0.0))
    )
    damp = F.when(F.col("rsi_zone") == "trung_tinh", 1.0).otherwise(0.85)
    rsi = (F.col("rsi") - 50.0) / 50.0 * 100.0 * damp + F.coalesce(
        clip(F.col("rsi_slope") * 10.0, -15.0, 15.0), F.lit(0.0))
    weight = (
        F.when(F.col("tk_strength") == "manh", 45.0)
        .when(F.col("tk_strength") == "trung_tinh", 25.0).otherwise(10.0)
    )
    direction = F.when(F.col("tk_cross") == "golden", 1.0).otherwise(-1.0)
    ichi = (
        F.when(F.col("zone") == "tren_may", 40.0).when(F.col("zone") == "duoi_may", -40.0)
        .otherwise(0.0)
        + F.coalesce(F.when(F.col("tk_cross").isNotNull(),
                            direction * weight * _decay(F.col("tk_bars"))), F.lit(0.0))
        + F.when(F.col("chikou_free"), 10.0)
        .when(~F.col("chikou_free"), -10.0).otherwise(0.0)
    )
    ichi = ichi * F.when(F.col("twist"), 0.85).otherwise(1.0)
    boost = F.coalesce(clip(F.col("thickness"), 0.0, 1.0) * 10.0, F.lit(0.0))
    df = df.withColumn("_ichi", ichi)
    ichi = F.col("_ichi") + F.when(F.col("_ichi") >= 0, boost).otherwise(-boost)
    df = df.withColumns({
        "score_macd": F.when(above.isNull(), 0.0).otherwise(clip(macd, -100.0, 100.0)),
        "score_rsi": F.when(F.col("rsi").isNull(), 0.0).otherwise(clip(rsi, -100.0, 100.0)),
        "score_ichimoku": F.when(F.col("zone").isNull(), 0.0)
        .otherwise(clip(ichi, -100.0, 100.0)),
    }).drop("_ichi")
    total = (
        S.TECH_WEIGHTS["macd"] * F.col("score_macd") + S.TECH_WEIGHTS["rsi"] * F.col("score_rsi")
        + S.TECH_WEIGHTS["ichimoku"] * F.col("score_ichimoku")
        - F.when(F.col("divergence") == "bearish", S.DIVERGENCE_PENALTY).otherwise(0.0)
    )
    return df.withColumn("total_score", clip(total, -100.0, 100.0))


def with_action(df: DataFrame) -> DataFrame:
    """Action with the cloud veto, confidence, entry, stop, target, risk/reward."""
    score = F.col("total_score")
    action = F.lit(S.ACTION_FLOOR)
    for floor, label in reversed(S.ACTIONS):
        action = F.when(score >= floor, label).otherwise(action)
    vetoed = F.coalesce(F.col("zone") == "duoi_may", F.lit(False))
    atr, close = F.coalesce("atr", F.lit(0.0)), F.col("close")
    stop = F.least(
        F.greatest(close - S.STOP_ATR * atr, F.col("kijun")), close * 0.999
    )
    df = df.withColumns({
        "vetoed": vetoed,
        "action": F.when(vetoed & (action == "MUA"), "TÍCH LUỸ").otherwise(action),
        "confidence": F.when(F.col("volume_ratio") < S.LOW_VOLUME_RATIO, "trung_binh")
        .otherwise("cao"),
        "entry_low": close,
        "entry_high": close + F.when(atr != 0, 0.25 * atr).otherwise(close * 0.005),
        "stop_loss": stop,
        "target": close + S.TARGET_ATR * atr,
        "resistance": F.least(
            F.when(F.col("senkou_a") > close, F.col("senkou_a")),
            F.when(F.col("senkou_b") > close, F.col("senkou_b"))),
    })
    risk = close - F.col("stop_loss")
    return df.withColumn("risk_reward", F.when(risk > 0, (F.col("target") - close) / risk))


def with_reasons(df: DataFrame) -> DataFrame:
    """The three explanation sentences (wording is a fixed value)."""
    bars = F.col("macd_bars").cast("string")
    above = F.coalesce(F.col("above_zero"), F.lit(False))
    macd = (
        F.when(F.col("macd_cross") == "golden", F.concat(
            F.lit("MACD vừa giao cắt vàng "),
            F.when(above, "trên đường 0 (tín hiệu mạnh)").otherwise("dưới đường 0"),
            F.lit(", "), bars, F.lit(" phiên trước.")))
        .when(F.col("macd_cross") == "death", F.concat(
            F.lit("MACD vừa giao cắt chết "),
            F.when(~above, "dưới đường 0 (tín hiệu mạnh)").otherwise("trên đường 0"),
            F.lit(", "), bars, F.lit(" phiên trước.")))
        .when(F.col("hist_slope") < 0,
              "Histogram MACD đang thu hẹp, động lượng suy yếu dù chưa giao cắt.")
        .when(F.col("hist_slope") > 0,
              "Histogram MACD đang mở rộng, động lượng đang mạnh lên.")
        .otherwise("MACD chưa cho tín hiệu rõ ràng do thiếu dữ liệu.")
    )
    note = (
        F.when(F.col("divergence") == "bullish", "phân kỳ dương (đà giảm suy yếu)")
        .when(F.col("divergence") == "bearish", "phân kỳ âm (đà tăng suy yếu)")
    )
    macd = F.when(note.isNotNull(), F.concat(
        macd, F.lit(" Ngoài ra giá và MACD đang xuất hiện "), note, F.lit("."))).otherwise(macd)

    def whole(c: str) -> Column:
        return F.bround(F.col(c), 0).cast("long").cast("string")

    rsi = (
        F.when(F.col("rsi").isNull(), "Chưa đủ dữ liệu để tính RSI.")
        .when(F.col("rsi_zone") == "qua_mua", F.concat(
            F.lit("RSI đang ở "), whole("rsi"), F.lit(", vượt ngưỡng thích ứng "), whole("upper"),
            F.lit(" — vùng quá mua.")))
        .when(F.col("rsi_zone") == "qua_ban", F.concat(
            F.lit("RSI đang ở "), whole("rsi"), F.lit(", dưới ngưỡng thích ứng "), whole("lower"),
            F.lit(" — vùng quá bán.")))
        .otherwise(F.concat(
            F.lit("RSI đang ở "), whole("rsi"), F.lit(", trong vùng trung tính ("), whole("lower"),
            F.lit("-"), whole("upper"), F.lit(").")))
    )
    place = (
        F.when(F.col("zone") == "tren_may", "trên mây Kumo")
        .when(F.col("zone") == "trong_may", "trong mây Kumo").otherwise("dưới mây Kumo")
    )
    force = (
        F.when(F.col("tk_strength") == "manh", "tín hiệu mạnh")
        .when(F.col("tk_strength") == "trung_tinh", "tín hiệu trung tính")
        .otherwise("tín hiệu yếu")
    )
    ichi = (
        F.when(F.col("zone").isNull(),
               "Chưa đủ dữ liệu để xác định vị trí so với mây Ichimoku.")
        .when(F.col("tk_cross").isNotNull(), F.concat(
            F.lit("Giá đang "), place, F.lit(", Tenkan/Kijun vừa giao cắt "),
            F.when(F.col("tk_cross") == "golden", "tăng").otherwise("giảm"),
            F.lit(" ("), force, F.lit(").")))
        .otherwise(F.concat(F.lit("Giá đang "), place, F.lit(".")))
    )
    return df.withColumns({"reason_macd": macd, "reason_rsi": rsi, "reason_ichimoku": ichi})


def last_bars(df: DataFrame) -> DataFrame:
    """The newest row of each symbol (position and symbol share the window sort)."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))
    return df.withColumn("_rn", newest).where(F.col("_rn") == 1).drop("_rn")


def recommendations(bars: DataFrame) -> DataFrame:
    return with_reasons(with_action(with_scores(technical_state(bars, wanted="last"))))


def screens(state: DataFrame) -> DataFrame:
    """Preset screens over the newest state of each symbol."""
    b, a, w = S.SCREENS["breakout"], S.SCREENS["accumulate"], S.SCREENS["warning"]
    breakout = (
        (F.col("zone") == "tren_may") & (F.col("break_bars") <= b["max_break_bars"])
        & (F.col("macd_cross") == "golden") & (F.col("macd_bars") <= b["max_cross_bars"])
        & (F.col("volume_ratio") >= b["min_volume_ratio"])
    )
    accumulate = (
        (F.col("zone") == "trong_may") & (F.col("thickness") <= a["max_thickness"])
        & (F.col("volume_ratio") <= a["max_volume_ratio"])
    )
    warning = (F.col("zone") == "duoi_may") & (F.col("break_bars") <= w["max_break_bars"])
    f = F.lit(False)
    return state.select(
        "symbol", F.coalesce(breakout, f).alias("breakout"),
        F.coalesce(accumulate, f).alias("accumulate"), F.coalesce(warning, f).alias("warning"),
    )
