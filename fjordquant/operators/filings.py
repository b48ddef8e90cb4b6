"""Filing text: sections, audit opinion, risk keywords, trends and commentary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.functions.text import sentences, squeeze

# headings of filing sections (fixed values)
SECTIONS = {
    "y_kien_kiem_toan": [r"ý kiến (của )?kiểm toán", r"báo cáo (của )?kiểm toán( độc lập)?"],
    "bang_can_doi": ["bảng cân đối kế toán"],
    "ket_qua_kinh_doanh": ["báo cáo kết quả hoạt động kinh doanh", "kết quả kinh doanh"],
    "luu_chuyen_tien_te": ["báo cáo lưu chuyển tiền tệ", "lưu chuyển tiền tệ"],
    "thuyet_minh": ["thuyết minh báo cáo tài chính", "thuyết minh"],
}
# audit opinions, most severe first (fixed values)
OPINIONS = {
    "trái ngược": ["ý kiến trái ngược", "không trình bày trung thực và hợp lý"],
    "từ chối": ["từ chối đưa ra ý kiến", "không thể đưa ra ý kiến"],
    "ngoại trừ": ["ý kiến ngoại trừ", "ngoại trừ ảnh hưởng", "ngoại trừ vấn đề"],
    "chấp nhận toàn phần": ["chấp nhận toàn phần", "ý kiến chấp nhận toàn phần",
                            "trình bày trung thực và hợp lý"],
}
# risk keyword groups with weights (fixed values)
RISKS = {
    "hoat_dong_lien_tuc": (5.0, ["khả năng hoạt động liên tục", "nghi ngờ đáng kể", "lỗ luỹ kế",
                                 "âm vốn chủ sở hữu"]),
    "no_va_thanh_khoan": (3.0, ["nợ xấu", "nợ quá hạn", "quá hạn thanh toán",
                                "vi phạm cam kết vay", "khả năng thanh toán"]),
    "phap_ly": (2.5, ["tranh chấp", "kiện tụng", "xử phạt", "thanh tra", "truy thu thuế"]),
    "du_phong": (2.0, ["trích lập dự phòng", "dự phòng giảm giá", "dự phòng phải thu khó đòi",
                       "tổn thất tài sản"]),
    "ben_lien_quan": (1.5, ["giao dịch với bên liên quan", "cho vay bên liên quan", "công ty mẹ"]),
}


def _positions(text: Column, pattern: str) -> Column:
    """1-based starts of all matches of a pattern in a text, in one linear scan.

    The pieces between the matches and the matches themselves give the
    positions by running sums of their lengths.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + F.length(x["piece"]) + 1
        return F.struct((at - 1 + F.length(x["hit"])).alias("end"),
                        F.concat(acc["at"], F.array(at)).alias("at"))

    zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))
    return F.aggregate(F.filter(zipped, lambda x: x["hit"].isNotNull()), start, step)["at"]


def _marks(text: Column, pattern: str, section: str) -> Column:
    return F.transform(_positions(text, pattern), lambda at: F.struct(
        at.alias("at"), F.lit(section).alias("section")))


def sections(docs: DataFrame, patterns: dict[str, list[str]] = SECTIONS) -> DataFrame:
    """(doc_id, section, start, body): from the first heading to the next one.

    Only heading positions go through the window; the text is joined back for
    the one cut per section.
    """
    marks = [_marks(F.col("_low"), p, key) for key, ps in patterns.items() for p in ps]
    rows = docs.select("doc_id", F.lower("text").alias("_low")).select(
        "doc_id", F.explode(F.concat(*marks)).alias("m")).select("doc_id", "m.at", "m.section")
    w = Window.partitionBy("doc_id").orderBy("at", "section")
    spans = rows.withColumn("until", F.lead("at").over(w))
    first = spans.groupBy("doc_id", "section").agg(
        F.min(F.struct("at", "until")).alias("s"))
    j = docs.select("doc_id", "text").join(first, "doc_id")
    until = F.coalesce(F.col("s.until"), F.length("text") + 1)
    return j.select("doc_id", "section", F.col("s.at").alias("start"), F.trim(
        F.substring(F.col("text"), F.col("s.at"), until - F.col("s.at"))).alias("body"))


def audit_opinion(docs: DataFrame, opinions: dict[str, list[str]] = OPINIONS) -> DataFrame:
    """First matching opinion by severity, with the phrase that shows it."""
    norm = squeeze(F.col("text"))
    df = docs.withColumn("_n", norm)
    entries = [(o, p) for o, phrases in opinions.items() for p in phrases]
    hit = F.coalesce(*[
        F.when(F.contains("_n", squeeze(F.lit(p))), F.struct(
            F.lit(o).alias("opinion"), F.lit(p).alias("evidence"))) for o, p in entries])
    return df.withColumn("_h", hit).select(
        "doc_id", "_h.opinion", "_h.evidence", (F.length(F.trim("text")) < 500).alias("scanned"))


def risk_hits(docs: DataFrame, risks: dict[str, tuple[float, list[str]]] = RISKS) -> DataFrame:
    """Every (keyword, sentence) match with its group and weight."""
    keywords = F.array(*[F.struct(
        F.lit(k).alias("keyword"), F.lit(g).alias("group"), F.lit(w).alias("weight"))
        for g, (w, ks) in risks.items() for k in ks])
    needles = F.transform(keywords, lambda k: F.struct(
        k["keyword"].alias("keyword"), k["group"].alias("group"), k["weight"].alias("weight"),
        squeeze(k["keyword"]).alias("needle")))
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    rows = rows.withColumn("_s", squeeze(F.col("sentence")))
    hit = F.filter(needles, lambda k: F.contains(F.col("_s"), k["needle"]))
    return rows.select("doc_id", "n", "sentence", F.explode(hit).alias("k")).select(
        "doc_id", "n", "k.keyword", "k.group", "k.weight", "sentence")


def trends(annual: DataFrame) -> DataFrame:
    """Per symbol: value maps by year, margins, CAGR over row count - 1, CFO/NI mean."""
    w = Window.partitionBy("symbol").orderBy("year")
    df = annual.withColumns({
        "margin": F.try_divide("net_income", "revenue"),
        "cfo_to_ni": F.try_divide("cfo", "net_income"),
        "ldr": F.try_divide("loans", "deposits"), "_n": F.row_number().over(w)})

    def by_year(c: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", c))))

    def cagr(c: str) -> Column:
        a, b = F.min_by(c, "year"), F.max_by(c, "year")
        n = F.count(F.lit(1)) - 1
        return F.when((a > 0) & (b > 0) & (n > 0), F.pow(b / a, 1.0 / F.greatest(n, F.lit(1))) - 1)

    last2 = F.max(F.struct("year", "revenue"))
    return df.groupBy("symbol").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        by_year("revenue").alias("revenue_by_year"), by_year("margin").alias("margin_by_year"),
        cagr("revenue").alias("revenue_cagr"), cagr("net_income").alias("net_income_cagr"),
        cagr("total_assets").alias("assets_cagr"), F.avg("cfo_to_ni").alias("cfo_to_ni_avg"),
        F.max_by("ldr", "year").alias("ldr_last"), last2["revenue"].alias("revenue_last"))


def growth_commentary(trend: DataFrame) -> DataFrame:
    """The growth paragraph: yearly revenue line and compound rates (fixed wording)."""
    items = F.transform(F.map_entries("revenue_by_year"), lambda e: F.concat(
        e["key"].cast("string"), F.lit(": "), F.format_number(e["value"] / 1e9, 0),
        F.lit(" tỷ đồng")))
    line = F.concat(F.lit("Doanh thu: "), F.array_join(items, " | "), F.lit("."))
    rate = F.when(F.col("revenue_cagr").isNotNull(), F.concat(
        F.lit("Tốc độ tăng trưởng kép doanh thu bình quân "),
        F.format_string("%+.1f%%", F.col("revenue_cagr") * 100), F.lit("/năm ("),
        F.col("first_year").cast("string"), F.lit("-"), F.col("last_year").cast("string"), F.lit(").")))
    profit = F.when(F.col("net_income_cagr").isNotNull(), F.concat(
        F.lit("Tốc độ tăng trưởng kép lợi nhuận sau thuế bình quân "),
        F.format_string("%+.1f%%", F.col("net_income_cagr") * 100), F.lit("/năm.")))
    return trend.select("symbol", F.concat_ws("\n", line, rate, profit).alias("growth_text"))


def text_contains_numbers(reports: DataFrame, within: int = 200) -> DataFrame:
    """PASS when ``token`` stands within N characters after ``label`` in ``text``."""
    at = F.instr("text", F.col("label"))
    near = F.substring("text", at, F.length("label") + within)
    status = (F.when((at == 0) | F.col("token").isNull(), "SKIP")
              .when(F.contains(near, F.col("token")), "PASS").otherwise("FAIL"))
    return reports.withColumn("status", status)
