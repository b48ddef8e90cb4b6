"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.llm import chat, decontaminate, quality, sharding
from fjordquant.llm.common import table
from fjordquant.llm.registry import query

SHARDS = 24


@query("op1_rendezvous_shards")
def op1_rendezvous_shards(spark, d):
    docs = table(spark, d, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = sharding.assign(
        docs, "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1),
        digest=[(F.octet_length(body).cast("long") + 8).alias("size"),
                F.crc32(body.cast("binary")).alias("text_crc32")])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                       "grown_shard")


@query("op2_template_windows")
def op2_template_windows(spark, d):
    return decontaminate.report(table(spark, d, "documents"), "doc_id", "text",
                                table(spark, d, "benchmark"), "item_id", "text")


def _quality_sql() -> str:
    stats = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, p, ws[p:p+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
again AS (SELECT r, unnest(range(p, p + 5)) AS q FROM (
  SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM again GROUP BY r),
s0 AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct
  FROM w LEFT JOIN rep ON rep.r = w.r),
s AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, """
    stats += ", ".join(f"{quality.vote(r)} AS v{i}" for i, r in enumerate(quality.RULES))
    stats += " FROM s0),\n"
    n = len(quality.RULES)
    names = ", ".join(f"v{i}" for i in range(n))
    stats += f"pat AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY ALL),\n"

    def post() -> str:
        odds = "ln(m.f / (1 - m.f))"
        for i in range(n):
            odds += (f" + CASE v{i} WHEN 1 THEN ln(m.a{i} / (1 - m.b{i}))"
                     f" WHEN -1 THEN ln((1 - m.a{i}) / m.b{i}) ELSE 0 END")
        return f"1 / (1 + exp(-({odds})))"

    w = f"{quality.PRIOR_WEIGHT}::DOUBLE"
    on_fine, on_poor = f"{quality.PRIOR_ON_FINE}::DOUBLE", f"{quality.PRIOR_ON_POOR}::DOUBLE"
    ctes = "m0 AS (SELECT " + f"{quality.PRIOR_FINE}::DOUBLE AS f, " + ", ".join(
        f"{on_fine} AS a{i}, {on_poor} AS b{i}" for i in range(n)) + ")"
    for k in range(quality.ROUNDS):
        rates = ", ".join(
            f"(coalesce(sum(CASE WHEN v{i} = 1 THEN n * p END), 0) + {w} * sum(n) * {on_fine})"
            f" / (coalesce(sum(CASE WHEN v{i} <> 0 THEN n * p END), 0) + {w} * sum(n)) AS a{i}, "
            f"(coalesce(sum(CASE WHEN v{i} = -1 THEN n * (1 - p) END), 0) + {w} * sum(n) * {on_poor})"
            f" / (coalesce(sum(CASE WHEN v{i} <> 0 THEN n * (1 - p) END), 0) + {w} * sum(n)) AS b{i}"
            for i in range(n))
        ctes += (f",\nm{k + 1} AS MATERIALIZED (SELECT (sum(n * p) + {w} * sum(n) * {quality.PRIOR_FINE}::DOUBLE)"
                 f" / (sum(n) * (1 + {w})) AS f, {rates}"
                 f" FROM (SELECT pat.*, {post()} AS p FROM pat, m{k} m))")
    return (stats + ctes + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {post()} >= {quality.KEEP_AT} AS kept FROM s, m{quality.ROUNDS} m""")


@query("op3_weak_supervision", _quality_sql())
def op3_weak_supervision(spark, d):
    rows = quality.score(table(spark, d, "documents"), "text", keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept")


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  CAST(sum(length(replace(replace(role, '<', '__'), '[', '__'))
    + CASE WHEN contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
      THEN length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) ELSE length(text) END + 25) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g"""


@query("op8_chat_round_trip", _CHAT_SQL)
def op8_chat_round_trip(spark, d):
    own = "</s>[INST] ok [/INST]"
    probe = spark.sql(
        f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{own}' AS text "
        f"UNION ALL SELECT -1L, 1L, 'assistant', '{own}'")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.format_conversations(rows.unionByName(probe), "conv_id", "turn", "role", "text")
    joined = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
