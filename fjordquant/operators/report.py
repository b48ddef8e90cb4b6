"""Report content: thesis and risk sentences, paragraphs, chart-ready tables.

Wording is a fixed value; everything else is column expressions over the
analysis table, so the whole market's texts come from one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.text import number_vi, percent_vi

TYPE_LABELS = {
    "BANK": "Ngân hàng", "SECURITIES": "Chứng khoán", "INSURANCE": "Bảo hiểm",
    "REAL_ESTATE": "Bất động sản", "NON_FINANCIAL": "Doanh nghiệp phi tài chính",
}


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def with_thesis_and_risks(df: DataFrame) -> DataFrame:
    """At most six thesis and seven risk sentences from threshold rules.

    Needs roe_last, roe_median, ni_cagr, upside, target_base, confidence,
    confidence_reason, company_type, cir, credit_cost, debt_to_equity_last,
    interest_coverage, cfo_to_ni3, vetoed, tech_total.
    """
    c = F.col
    roe, med, g, up = c("roe_last"), c("roe_median"), c("ni_cagr"), c("upside")
    bank, low = c("company_type") == "BANK", c("confidence") == S.LOW
    sure = up.isNotNull() & ~low
    growth = _say("LNST công ty mẹ CAGR ", c("years"), ": ", percent_vi(g))
    target = _say("Giá mục tiêu ", number_vi(c("target_base")), " đ/cp, ",
                  F.when(up >= 0, "tiềm năng tăng").otherwise("thấp hơn giá hiện tại"), " ",
                  percent_vi(F.abs(up)), ".")
    thesis = [
        F.when(roe > med * 1.1, _say("Hiệu quả sinh lời vượt trội: ROE ", percent_vi(roe),
                                     " so với trung vị ngành ", percent_vi(med), ".")),
        F.when(g > 0.10, _say(growth, " — tăng trưởng mạnh.")).when(g >= 0, _say(growth, ".")),
        F.when(sure & (up >= -0.05), target),
        F.when(bank & (c("cir") < 0.35), _say("Vận hành hiệu quả: CIR ", percent_vi(c("cir")), ".")),
        F.when(~bank & (c("cfo_to_ni3") > 1.0), _say(
            "Lợi nhuận chuyển hóa tốt thành tiền: CFO/LNST bq 3 năm ", number_vi(c("cfo_to_ni3"), 2),
            " lần.")),
        F.when(~c("vetoed") & (c("tech_total") > 20), _say(
            "Kỹ thuật tích cực (điểm hợp lưu MACD/RSI/Ichimoku ",
            F.format_string("%+.0f", c("tech_total")), ").")),
    ]
    risks = [
        F.when(roe < med * 0.8, _say("ROE ", percent_vi(roe), " thấp hơn trung vị ngành ",
                                     percent_vi(med), ".")),
        F.when(g < 0, _say(growth, " — suy giảm.")),
        F.when(sure & (up < -0.05), target).when(low, _say(
            "Định giá chưa đủ tin cậy: ", c("confidence_reason"),
            ". Khuyến nghị theo dõi, không xếp MUA/BÁN.")),
        F.when(bank & (c("credit_cost") > 0.015), _say(
            "Chi phí tín dụng cao (", percent_vi(c("credit_cost")), ") — rủi ro chất lượng tài sản.")),
        F.when(~bank & (c("debt_to_equity_last") > 1.5), _say(
            "Đòn bẩy cao: vay nợ/VCSH ", number_vi(c("debt_to_equity_last"), 2), " lần.")),
        F.when(~bank & (c("interest_coverage") < 3), _say(
            "Khả năng trả lãi yếu: EBIT/lãi vay ", number_vi(c("interest_coverage"), 1), " lần.")),
        F.when(~bank & (c("cfo_to_ni3") < 0.8), _say(
            "Chất lượng lợi nhuận thấp: CFO/LNST bq 3 năm ", number_vi(c("cfo_to_ni3"), 2), " lần.")),
        F.when(c("vetoed"), "Kỹ thuật: giá nằm dưới mây Ichimoku — xu hướng ngắn hạn chưa ủng hộ.")
        .when(c("tech_total") < -20, _say("Kỹ thuật tiêu cực (điểm hợp lưu ",
                                          F.format_string("%+.0f", c("tech_total")), ").")),
        F.lit("Rủi ro chung: biến động thị trường, thay đổi chính sách tiền tệ/tài khóa, "
              "sai lệch giả định định giá."),
    ]
    return df.withColumns({
        "thesis": F.slice(F.array_compact(F.array(*thesis)), 1, 6),
        "risks": F.slice(F.array_compact(F.array(*risks)), 1, 7)})


def company_paragraph(annual: DataFrame, growth: DataFrame) -> DataFrame:
    """One sentence per company on its newest year and compound growth."""
    newest = annual.groupBy("symbol").agg(F.max_by(F.struct(
        "year", "revenue", "total_operating_income", "net_income_parent"), "year").alias("n"))
    j = growth.join(newest, "symbol")
    bank = F.col("company_type") == "BANK"
    top = F.when(bank, F.col("n.total_operating_income")).otherwise(F.col("n.revenue"))
    text = _say(
        "Năm ", F.col("n.year").cast("string"),
        F.when(bank, ", tổng thu nhập hoạt động đạt ").otherwise(", doanh thu thuần đạt "),
        number_vi(top / 1e9), " tỷ đồng, LNST công ty mẹ ", number_vi(F.col("n.net_income_parent") / 1e9),
        " tỷ đồng; CAGR ", F.col("first_year").cast("string"), "–", F.col("last_year").cast("string"),
        F.when(bank, ": thu nhập ").otherwise(": doanh thu "), percent_vi(F.col("top_line_cagr")),
        ", LNST ", percent_vi(F.col("ni_cagr")), ".")
    return j.select("symbol", text.alias("paragraph"))


def method_ranges(valued: DataFrame, methods: list[str]) -> DataFrame:
    """Lowest, base and highest value per valuation method."""
    items = F.explode(F.array(*[F.struct(
        F.lit(m).alias("method"),
        F.least(f"{m}_bear", f"{m}_base", f"{m}_bull").alias("low"), F.col(f"{m}_base").alias("base"),
        F.greatest(f"{m}_bear", f"{m}_base", f"{m}_bull").alias("high")) for m in methods]))
    return valued.select("symbol", items.alias("x")).select("symbol", "x.*").where(
        F.col("base").isNotNull())


def equal_weight_index(bars: DataFrame, members: DataFrame, start: Column,
                       min_bars: int = 20) -> DataFrame:
    """(node, time, value): mean of members' rebased, forward-filled closes.

    A member counts from its first bar on; its value changes only on its bars,
    so running sums of the changes and of the members replace a filled grid.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    whole = Window.partitionBy("symbol")
    own = bars.where(F.col("time") >= start).withColumns({
        "base": F.first("close").over(w), "n": F.count(F.lit(1)).over(whole)})
    own = own.where(F.col("n") > min_bars).withColumn("v", F.col("close") / F.col("base"))
    prev = F.lag("v").over(w)
    moves = own.select("symbol", "time", (F.col("v") - F.coalesce(prev, F.lit(0.0))).alias("dv"),
                       prev.isNull().cast("int").alias("joined"))
    daily = moves.join(members, "symbol").groupBy("node", "time").agg(
        F.sum("dv").alias("dv"), F.sum("joined").alias("joined"))
    run = Window.partitionBy("node").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("node", "time", (
        F.sum("dv").over(run) / F.sum("joined").over(run) * 100).alias("value"))


def calendar_changes(series: DataFrame, by: str, spans: dict[str, int]) -> DataFrame:
    """Return of each series' last value over calendar days, last value on or before."""
    df = series.withColumn("d", F.unix_date("time"))
    order = Window.partitionBy(by).orderBy("d")
    df = df.withColumns({f"_{k}": F.last("value").over(
        order.rangeBetween(Window.unboundedPreceding, -n)) for k, n in spans.items()})
    return df.groupBy(by).agg(*[(F.max_by("value", "d") / F.coalesce(
        F.max_by(f"_{k}", "d"), F.min_by("value", "d")) - 1).alias(f"ret_{k}") for k in spans])


def filings_index(filings: DataFrame, base: str) -> DataFrame:
    """Filings per ticker, newest first, with their links."""
    w = Window.partitionBy("ticker").orderBy(F.desc("year"), "file_name")
    return filings.withColumns({
        "rank": F.row_number().over(w),
        "link": F.concat(F.lit(base), "ticker", F.lit("/"), "file_name")})
