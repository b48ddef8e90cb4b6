"""News, text functions and filings over the document tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fjordquant.catalog import statements as _statements  # noqa: F401
from fjordquant.catalog.registry import query
from fjordquant.catalog.statements import annual_typed
from fjordquant.functions import text as X
from fjordquant.functions.numeric import rounded
from fjordquant.operators import filings as FI
from fjordquant.operators import news as N
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_

GOOD = ["tion", "hand", "inthe", "ering", "ment"]
BAD = ["er ", "or ", "sch", "esen", "oun"]
FOLD = "replace(lower(strip_accents({0})), 'đ', 'd')"
WORDS = "trim(regexp_replace(" + FOLD + ", '[^a-z0-9]+', ' ', 'g'))"


def _hits(terms):
    return "list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda t: contains(norm, t))"


define("scored_news", f"""
SELECT *, CASE WHEN len(pos) + len(neg) > 0 THEN (len(pos) - len(neg)) / CAST(len(pos) + len(neg) AS DOUBLE) ELSE 0e0 END AS sentiment
FROM (SELECT *, {_hits(GOOD)} AS pos, {_hits(BAD)} AS neg FROM (SELECT *, {FOLD.format('title')} AS norm FROM news))""", ("news",))


def scored(spark, d):
    return N.with_title_score(D.news(spark, d), GOOD, BAD)


@query("title_sentiment", "TXT-1 STR-1", with_("scored_news", "SELECT guid, len(pos) AS n_pos, len(neg) AS n_neg, round(sentiment, 8) AS sentiment FROM scored_news"))
def title_sentiment(spark, d):
    return rounded(scored(spark, d).select("guid", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"), "sentiment"),
                   {"sentiment": 8})


@query("source_sentiment", "TXT-1", with_("scored_news", """
WITH w AS (SELECT *, CASE WHEN len(pos) > 0 OR len(neg) > 0 THEN power(0.5e0, greatest(DATE '2024-06-30' - published_at, 0) / 30e0) END AS w FROM scored_news),
s AS (SELECT source, coalesce(sum(w * sentiment) / sum(w), 0) AS score, count_if(sentiment > 0) AS n_pos, count_if(sentiment < 0) AS n_neg, count(*) AS n_items FROM w GROUP BY 1)
SELECT source, round(score, 7) AS score, round(least(greatest(50 + 40 * score, 0), 100), 5) AS score_100, n_pos, n_neg, n_items FROM s"""))
def source_sentiment(spark, d):
    return rounded(N.sentiment(scored(spark, d), F.lit("2024-06-30").cast("date"), ["source"]),
                   {"score": 7, "score_100": 5})


@query("news_categories", "TXT-2", with_("news", """
SELECT guid, CASE WHEN regexp_matches(title || ' ' || body, 'nicht|(au|s)lich', 'i') THEN 'CHÍNH SÁCH - PHÁP LUẬT' WHEN regexp_matches(title || ' ' || body, 'tion|ment', 'i') THEN 'VĨ MÔ & THỊ TRƯỜNG' ELSE 'DOANH NGHIỆP & NGÀNH' END AS category,
  CASE WHEN length(body) > 180 THEN left(body, 180) || '...' ELSE body END AS summary FROM news"""))
def news_categories(spark, d):
    n = D.news(spark, d)
    return n.select("guid", N.classify(F.col("title"), F.col("body"), ["nicht", "(au|s)lich"], ["tion", "ment"]).alias("category"),
                    N.short_summary(F.col("body")).alias("summary"))


@query("news_relevance", "TXT-2", with_("news", "SELECT guid, regexp_matches(title, '(^|[^\\p{L}\\p{N}_])(gdp|cpi|fdi|nhnn|ubck|ubcknn)($|[^\\p{L}\\p{N}_])|vn-?index', 'i') AS relevant FROM news"))
def news_relevance(spark, d):
    return D.news(spark, d).select("guid", N.is_relevant(F.col("title"), F.lit("")).alias("relevant"))


# listed companies for matching: tickers and names out of the benchmark passages
define("firms", r"""
SELECT min(item_id) AS symbol, upper(regexp_extract(text, '^(\w+) (\w+) (\w+)', 1)) AS code, min(regexp_extract(text, '^(\w+) (\w+) (\w+)', 2) || ' ' || regexp_extract(text, '^(\w+) (\w+) (\w+)', 3)) AS brand,
  min(regexp_extract(text, '^(\w+ \w+ \w+)', 1)) AS name FROM benchmark WHERE regexp_matches(text, '^(\w+) (\w+) (\w+)') GROUP BY 2""")


def firms(spark, d):
    b = D.table(spark, d, "benchmark").where(F.col("text").rlike(r"^(\w+) (\w+) (\w+)"))

    def g(i):
        return F.regexp_extract("text", r"^(\w+) (\w+) (\w+)", i)

    return b.groupBy(F.upper(g(1)).alias("code")).agg(
        F.min("item_id").alias("symbol"), F.min(F.concat_ws(" ", g(2), g(3))).alias("brand"),
        F.min(F.regexp_extract("text", r"^(\w+ \w+ \w+)", 1)).alias("name"))


define("matched", f"""
WITH t AS MATERIALIZED (SELECT guid, upper(title || ' ' || body) AS u, ' ' || {WORDS.format("title || ' ' || body")} || ' ' AS w, list_distinct(regexp_extract_all(upper(title || ' ' || body), '[\\p{{L}}\\p{{N}}_]+')) AS tk FROM news),
c AS MATERIALIZED (SELECT symbol, code, {WORDS.format('brand')} AS b, {WORDS.format('name')} AS n FROM firms)
SELECT guid, symbol, reason FROM (SELECT t.guid, c.symbol, CASE
  WHEN list_contains(tk, code) THEN 'mã cổ phiếu xuất hiện độc lập'
  WHEN length(b) >= 5 AND contains(w, ' ' || b || ' ') THEN 'khớp thương hiệu không dấu'
  WHEN length(n) >= 5 AND contains(w, ' ' || n || ' ') THEN 'khớp tên doanh nghiệp không dấu' END AS reason FROM t, c) WHERE reason IS NOT NULL""", ("news", "firms"))


@query("news_company_matches", "JN-14 UDF-5", with_("matched", "SELECT guid, symbol, reason FROM matched"))
def news_company_matches(spark, d):
    return N.match_companies(D.news(spark, d), firms(spark, d), ambiguous=[])


def feed(spark, d):
    """Two feeds: the documents, and their even half again under the same titles."""
    n = D.news(spark, d).withColumn("published_at", F.col("published_at").cast("timestamp"))
    first = n.withColumns({"link": F.concat(F.lit("a/"), F.col("guid") % 700), "feed_order": F.lit(1)})
    second = n.where(F.col("guid") % 2 == 0).withColumns({
        "link": F.concat(F.lit("b/"), "guid"), "feed_order": F.lit(2),
        "published_at": F.col("published_at") + F.expr("interval 9 hours")})
    return N.merge_feeds([first.withColumn("guid", F.col("guid")), second])


define("feed", f"""
WITH u AS (SELECT guid, title, body, source, CAST(published_at AS TIMESTAMP) AS published_at, 'a/' || (guid % 700) AS link, 1 AS feed_order FROM news
  UNION ALL SELECT guid, title, body, source, CAST(published_at AS TIMESTAMP) + INTERVAL 9 HOUR, 'b/' || guid, 2 FROM news WHERE guid % 2 = 0),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY link ORDER BY (hour(published_at) + minute(published_at) > 0)::INT DESC, feed_order, guid DESC) = 1)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {WORDS.format('title')} ORDER BY (hour(published_at) + minute(published_at) > 0)::INT DESC, feed_order, link DESC) = 1""", ("news",))


@query("merged_feed", "TXT-3 SET-3 SRC-16", with_("feed", f"SELECT count(*) AS n, count(DISTINCT {WORDS.format('title')}) AS n_titles, count(DISTINCT link) = count(*) AS unique_links FROM feed"))
def merged_feed(spark, d):
    return feed(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(X.words_only(F.col("title"))).alias("n_titles"),
        (F.count_distinct("link") == F.count(F.lit(1))).alias("unique_links"))


@query("company_news", "TXT-3 TXT-10", with_("matched scored_news", """
SELECT symbol, guid, reason, source, published_at, round(sentiment, 8) AS sentiment, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC NULLS LAST, guid) AS rank
FROM matched JOIN scored_news USING (guid) QUALIFY rank <= 30"""))
def company_news(spark, d):
    m = N.match_companies(D.news(spark, d), firms(spark, d), ambiguous=[]).join(scored(spark, d), "guid")
    return rounded(N.newest_per(m, "symbol").select(
        "symbol", "guid", "reason", "source", "published_at", "sentiment", "rank"), {"sentiment": 8})


@query("news_audit", "TXT-10", with_("matched news", """
SELECT symbol, source, count_if(DATE '2024-06-30' - published_at <= 30) AS d30, count_if(DATE '2024-06-30' - published_at <= 180) AS d180, count(*) AS returned, count(*) >= 30 AS capped
FROM matched JOIN news USING (guid) GROUP BY 1, 2"""))
def news_audit(spark, d):
    m = N.match_companies(D.news(spark, d), firms(spark, d), ambiguous=[]).join(
        D.news(spark, d).select("guid", "source", "published_at"), "guid")
    return N.audit(m, F.lit("2024-06-30").cast("date"))


LINK = r'(?s)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


@query("article_links", "TXT-4 STR-6", r"""
WITH e AS (SELECT page_id, regexp_extract_all(html, '(?s)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
u AS (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href, unnest(t) AS raw FROM e),
c AS (SELECT page_id, pos, href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM u),
f AS (SELECT * FROM c WHERE length(title) >= 3 QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, href, title FROM f QUALIFY rank <= 25""")
def article_links(spark, d):
    return N.article_links(D.table(spark, d, "pages"), LINK, min_title=3)


@query("page_text", "STR-6", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, d):
    return D.table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("folded_titles", "STR-1 STR-2 STR-3", with_("news", f"""
SELECT guid, {WORDS.format('title')} AS words, CASE WHEN s = '' THEN '2-na' ELSE '2-' || s END AS node_key, trim(regexp_replace({FOLD.format('title')}, '[^0-9a-z]+', '_', 'g'), '_') AS snake
FROM (SELECT *, trim(regexp_replace({FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '-') AS s FROM news)"""))
def folded_titles(spark, d):
    t = F.col("title")
    return D.news(spark, d).select("guid", X.words_only(t).alias("words"), X.node_key(2, t).alias("node_key"), X.snake(t).alias("snake"))


@query("vietnamese_numbers", "STR-4 STR-5", """
SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '_'), '.', ','), '_', '.') AS price_vi,
  (CASE WHEN o_totalprice % 3 < 1 THEN '+' ELSE '' END) || replace(format('{:.1f}', round(o_totalprice / 1000, 1)), '.', ',') || '%' AS share_vi, true AS same_numbers, 2 AS n_numbers FROM orders""")
def vietnamese_numbers(spark, d):
    o = D.table(spark, d, "orders")
    p = F.col("o_totalprice")
    western = F.concat(F.lit("from "), F.format_number(p, 2), F.lit(" on "), F.col("o_orderkey") + 1, F.lit("."))
    local = F.concat(F.lit("ngày "), F.col("o_orderkey") + 1, F.lit(" là "), X.number_vi(p, 2), F.lit(" đ"))
    a, b = X.numbers_in(western), X.numbers_in(local)
    sign = F.when(p % 3 < 1, "+").otherwise("")
    return o.select("o_orderkey", X.number_vi(p, 2).alias("price_vi"),
                    F.concat(sign, X.number_vi(F.round(p / 1000, 1), 1), F.lit("%")).alias("share_vi"),
                    (a == b).alias("same_numbers"), F.size(a).alias("n_numbers"))


@query("document_sentences", "STR-7", r"""
SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (
 SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)""")
def document_sentences(spark, d):
    s = X.sentences(F.col("text"))
    df = D.table(spark, d, "documents").withColumn("s", s)
    return df.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(
        F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


HEADINGS = {"alpha": ["onnthe", "esinth"], "beta": ["thand"], "gamma": ["er(s|ed) "]}


def _marks_sql() -> str:
    parts = [f"""SELECT doc_id, '{k}' AS section, '{p}' AS pat, generate_subscripts(regexp_extract_all(lower(text), '(?s).*?(?:{p})'), 1) AS ord,
  unnest(regexp_extract_all(lower(text), '(?s).*?(?:{p})')) AS seg, unnest(regexp_extract_all(lower(text), '(?:{p})')) AS hit FROM documents"""
             for k, ps in HEADINGS.items() for p in ps]
    return " UNION ALL ".join(parts)


define("marks", "SELECT doc_id, section, CAST(sum(length(seg)) OVER (PARTITION BY doc_id, pat ORDER BY ord ROWS UNBOUNDED PRECEDING) - length(hit) + 1 AS BIGINT) AS pos FROM (" + _marks_sql() + ")")


@query("filing_sections", "TXT-5", with_("marks", """
WITH s AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, section) AS until FROM marks),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) = 1)
SELECT doc_id, section, pos AS start, trim(substring(text, pos, coalesce(until, length(text) + 1) - pos), ' ') AS body FROM f JOIN documents USING (doc_id)"""))
def filing_sections(spark, d):
    return FI.sections(D.table(spark, d, "documents"), HEADINGS)


@query("audit_opinions", "TXT-6", """
SELECT doc_id, CASE WHEN contains(n, 'thand') THEN 'adverse' WHEN contains(n, 'onnthe') OR contains(n, 'inthe') THEN 'qualified' WHEN contains(n, 'the') THEN 'clean' END AS opinion,
  CASE WHEN contains(n, 'thand') THEN 'thand' WHEN contains(n, 'onnthe') THEN 'onnthe' WHEN contains(n, 'inthe') THEN 'inthe' WHEN contains(n, 'the') THEN 'the' END AS evidence, length(trim(text)) < 500 AS scanned
FROM (SELECT *, trim(regexp_replace(""" + FOLD.format("text") + """, '\\s+', ' ', 'g')) AS n FROM documents)""")
def audit_opinions(spark, d):
    return FI.audit_opinion(D.table(spark, d, "documents"),
                            {"adverse": ["thand"], "qualified": ["onnthe", "inthe"], "clean": ["the"]})


RISK = {"liquidity": (3.0, ["onnthe", "thand"]), "legal": (2.5, ["erthe", "ment"])}


@query("risk_keyword_hits", "TXT-7", r"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentence FROM documents),
k AS (SELECT * FROM (VALUES ('onnthe', 'liquidity', 3e0), ('thand', 'liquidity', 3e0), ('erthe', 'legal', 2.5e0), ('ment', 'legal', 2.5e0)) v(keyword, grp, weight))
SELECT doc_id, keyword, grp AS "group", count(*) AS hits, sum(weight) AS weight FROM s JOIN k ON contains(""" + FOLD.format("sentence") + """, keyword) GROUP BY 1, 2, 3""")
def risk_keyword_hits(spark, d):
    return FI.risk_hits(D.table(spark, d, "documents"), RISK).groupBy("doc_id", "keyword", "group").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("weight"))


@query("filing_trends", "TXT-8 AGG-17", with_("annual", """
SELECT symbol, min(year) AS first_year, max(year) AS last_year, round(power(max_by(revenue, year) / min_by(revenue, year), 1e0 / (count(*) - 1)) - 1, 8) AS revenue_cagr,
  round(CASE WHEN min_by(net_income, year) > 0 AND max_by(net_income, year) > 0 THEN power(max_by(net_income, year) / min_by(net_income, year), 1e0 / (count(*) - 1)) - 1 END, 8) AS net_income_cagr,
  round(avg(cfo / net_income), 6) AS cfo_to_ni_avg, round(max_by(loans / deposits, year), 8) AS ldr_last FROM annual GROUP BY 1"""))
def filing_trends(spark, d):
    df = FI.trends(annual_typed(spark, d))
    return rounded(df.select("symbol", "first_year", "last_year", "revenue_cagr", "net_income_cagr", "cfo_to_ni_avg", "ldr_last"),
                   {"revenue_cagr": 8, "net_income_cagr": 8, "cfo_to_ni_avg": 6, "ldr_last": 8})


@query("growth_commentary", "TXT-8", with_("annual", """
WITH t AS (SELECT symbol, min(year) AS a, max(year) AS b, count(*) AS n, string_agg(year || ': ' || format('{:,.0f}', revenue / 1e9) || ' tỷ đồng', ' | ' ORDER BY year) AS l, min_by(revenue, year) AS r0, max_by(revenue, year) AS r1,
   min_by(net_income, year) AS n0, max_by(net_income, year) AS n1 FROM annual GROUP BY 1)
SELECT symbol, concat_ws(chr(10), 'Doanh thu: ' || l || '.', printf('Tốc độ tăng trưởng kép doanh thu bình quân %+.1f%%/năm (%d-%d).', (power(r1 / r0, 1e0 / (n - 1)) - 1) * 100, a, b),
  CASE WHEN n0 > 0 AND n1 > 0 THEN printf('Tốc độ tăng trưởng kép lợi nhuận sau thuế bình quân %+.1f%%/năm.', (power(n1 / n0, 1e0 / (n - 1)) - 1) * 100) END) AS growth_text FROM t"""))
def growth_commentary(spark, d):
    return FI.growth_commentary(FI.trends(annual_typed(spark, d)))


@query("report_numbers_present", "CHK-6", """
SELECT doc_id, CASE WHEN position(label IN text) = 0 THEN 'SKIP' WHEN contains(substring(text, CAST(position(label IN text) AS BIGINT), length(label) + 200), token) THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT doc_id, text, 'the' AS label, CASE WHEN doc_id % 2 = 0 THEN 'and' ELSE 'tion' END AS token FROM documents)""")
def report_numbers_present(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text", F.lit("the").alias("label"), F.when(
        F.col("doc_id") % 2 == 0, "and").otherwise("tion").alias("token"))
    return FI.text_contains_numbers(docs).select("doc_id", "status")


@query("trading_sessions", "DT-2", """
SELECT event_id, CASE WHEN isodow(l) >= 6 THEN 'Ngày nghỉ' WHEN t < '09:00' THEN 'Chưa mở cửa' WHEN t < '09:15' THEN 'ATO' WHEN t < '11:30' THEN 'Liên tục' WHEN t < '13:00' THEN 'Nghỉ trưa'
  WHEN t < '14:30' THEN 'Liên tục' WHEN t < '14:45' THEN 'ATC' ELSE 'Đóng cửa' END AS session FROM (SELECT event_id, ts + INTERVAL 7 HOUR AS l, strftime(ts + INTERVAL 7 HOUR, '%H:%M') AS t FROM events)""")
def trading_sessions(spark, d):
    return D.quotes(spark, d).select("event_id", N.market_session(F.col("ts")).alias("session"))


@query("fresh_items", "DT-3 STM-5", """
SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events WHERE epoch(date_trunc('second', ts)) >= epoch(date_trunc('second', (SELECT max(ts) FROM events))) - 7200""")
def fresh_items(spark, d):
    items = D.quotes(spark, d).select("event_id", F.col("ts").alias("published_at"))
    now = items.agg(F.max("published_at")).scalar()
    # two hours of one feed, newest first
    newest = Window.orderBy(F.desc("published_at"), "event_id")
    return N.fresh(items, now).select("event_id", F.row_number().over(newest).cast("long").alias("place"))


@query("feed_dates", "DT-3", """
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS epoch, CAST(ts AS DATE) AS id_date, ts >= TIMESTAMP '2024-01-30 22:00:00' AS fresh FROM events""")
def feed_dates(spark, d):
    q = D.quotes(spark, d)
    rfc = F.date_format("ts", "dd MMM yyyy HH:mm:ss").alias("x")
    q = q.withColumns({
        "rfc": F.concat(F.lit("Mon, "), rfc, F.lit(" GMT")),
        "aid": F.concat(F.lit("188"), F.date_format("ts", "yyMMdd"), F.lit("1234567"))})
    parsed = N.parse_rfc822(F.col("rfc"))
    return q.select("event_id", F.unix_timestamp(parsed).alias("epoch"),
                    N.date_from_article_id(F.col("aid")).alias("id_date"),
                    (F.col("ts") >= F.lit("2024-01-30 22:00:00").cast("timestamp")).alias("fresh"))
