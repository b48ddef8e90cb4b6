"""Quality by weak supervision: rules vote or abstain, a label model weighs them.

Each rule votes +1 (fine), -1 (poor) or 0 (abstains).  A generative model with
conditionally independent votes is fitted by expectation-maximisation: the
corpus collapses to the counts of its vote patterns (3^rules rows at most,
whatever the corpus holds), each pass over that table re-estimates how often
every rule votes which way on fine and on poor documents, and a document's
quality is the posterior of its own pattern.

Edge cases: null text counts as empty; a text without a word has all counts 0,
fails the base rule and is never kept; ties of the posterior at exactly one half
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordquant.llm.common import fresh, window_hashes, words_of
from fjordquant.session import materialise

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_distinct"]


def with_repeat_words(df: DataFrame, windows: str, name: str) -> DataFrame:
    """Attach the words inside windows of WINDOW words that the text holds twice or more.

    Only a text in which some window repeats sorts its (hash, position) pairs.
    Equal neighbours are the repeated windows; each covers the words up to the
    next repeated window, WINDOW at most.  Each step is a column of its own, as a
    lambda would work it out again for every element.
    """
    pairs, at = fresh(df, "_pairs", "_at")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    p = F.col(pairs)

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(other["h"] == x["h"], F.lit(False))

    out = df.withColumn(pairs, F.when(
        F.size(F.array_distinct(windows)) == F.size(windows), none
    ).otherwise(F.sort_array(F.transform(
        windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn(pairs, F.filter(p, lambda x, k: same(x, F.get(p, k - 1))
                                         | same(x, F.get(p, k + 1))))
    out = out.withColumn(at, F.sort_array(F.transform(pairs, lambda x: x["i"])))
    nearest = F.transform(at, lambda x, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col(at), k + 1) - x, F.lit(WINDOW))))
    return out.withColumn(name, F.aggregate(
        nearest, F.lit(0).cast("long"), lambda acc, g: acc + g)).drop(pairs, at)


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Attach the counts that the rules read; clashing columns are replaced."""
    out = df.drop(*STATS, "base_failed")
    body, words, hashes, windows, lines = fresh(out, "_body", "_words", "_hashes", "_windows",
                                                "_lines")
    out = out.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, words_of(F.col(body)))
    out = out.withColumn(hashes, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    out = out.withColumns({
        windows: window_hashes(F.col(hashes), WINDOW),
        lines: F.filter(F.split(F.col(body), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(body), F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_distinct": F.size(F.array_distinct(hashes)).cast("long"),
    })
    out = with_repeat_words(out, windows, "n_repeat_words")
    return out.drop(body, words, hashes, windows, lines).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``poor`` holds, else +1 where ``fine`` holds, else abstains."""

    name: str
    poor: str
    fine: str


RULES = [
    Rule("length", "n_words < 10", "n_words >= 50"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("lines", "n_dup_lines >= 2 AND 10 * n_dup_lines > 4 * n_lines",
         "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("repeats", "20 * n_repeat_words > 3 * n_words",
         "50 * n_repeat_words <= n_words AND n_words >= 20"),
    Rule("symbol_density", "20 * n_symbols > word_chars", "500 * n_symbols <= word_chars"),
    Rule("word_length", "n_words >= 20 AND (word_chars < 3 * n_words OR 10 * word_chars > 72 * n_words)",
         "2 * word_chars >= 7 * n_words AND 2 * word_chars <= 13 * n_words"),
    Rule("variety", "n_words BETWEEN 15 AND 2000 AND 10 * n_distinct < 4 * n_words",
         "n_words >= 15 AND 10 * n_distinct >= 6 * n_words"),
]

ROUNDS = 12
PRIOR_FINE = 0.9      # share of fine documents before any vote is seen
PRIOR_ON_FINE = 0.95  # a rule rarely calls a fine document poor ...
PRIOR_ON_POOR = 0.5   # ... and calls about every other poor one poor, before any vote is seen
PRIOR_WEIGHT = 0.05   # strength of both beliefs, as a share of the corpus
KEEP_AT = 0.5


def vote(rule: Rule) -> str:
    return f"CASE WHEN {rule.poor} THEN -1 WHEN {rule.fine} THEN 1 ELSE 0 END"


@dataclass(frozen=True)
class LabelModel:
    """Share of fine documents; per rule, how often its votes are right on either kind."""

    fine: float
    right_on_fine: tuple[float, ...]
    right_on_poor: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        # weights are looked up by the vote and not spelled out: numbers are written into the
        # generated code, so every round of the fit would be compiled anew
        odds, prior = None, math.log(self.fine / (1 - self.fine))
        for v, a, b in zip(votes, self.right_on_fine, self.right_on_poor):
            weights = [math.log((1 - a) / b), 0.0, math.log(a / (1 - b))]
            if odds is None:
                weights = [prior + w for w in weights]
            place = F.when(v == 1, 2).when(v == -1, 0).otherwise(1)
            weight = F.get(F.array(*[F.lit(w) for w in weights]), place)
            odds = weight if odds is None else odds + weight
        return 1 / (1 + F.exp(-(F.lit(prior) if odds is None else odds)))


def first_model(rules: int) -> LabelModel:
    return LabelModel(PRIOR_FINE, (PRIOR_ON_FINE,) * rules, (PRIOR_ON_POOR,) * rules)


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the counts of the vote patterns.

    A round is one aggregation of at most 3^rules rows; only its sums, four per
    rule, reach the driver.
    """
    patterns = materialise(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    model, posterior = first_model(len(names)), fresh(patterns, "_p")[0]
    p, n = F.col(posterior), F.col("_n")
    sums = [F.sum(n), F.sum(n * p)]
    for v in names:
        cast, on = F.col(v) != 0, F.col(v)
        sums += [F.sum(F.when(on == 1, n * p)), F.sum(F.when(cast, n * p)),
                 F.sum(F.when(on == -1, n * (1 - p))), F.sum(F.when(cast, n * (1 - p)))]
    sums = [s.alias(f"_s{i}") for i, s in enumerate(sums)]
    for _ in range(rounds):
        # a column of its own, so that the sums do not each work it out
        weighed = patterns.withColumn(posterior, model.posterior([F.col(v) for v in names]))
        row = weighed.agg(*sums).first()
        if not row[0]:
            break
        weight = PRIOR_WEIGHT * row[0]
        rate = lambda hit, of, prior: ((hit or 0.0) + weight * prior) / ((of or 0.0) + weight)
        at = range(2, len(row), 4)
        model = LabelModel(
            (row[1] + weight * PRIOR_FINE) / (row[0] + weight),
            tuple(rate(row[i], row[i + 1], PRIOR_ON_FINE) for i in at),
            tuple(rate(row[i + 2], row[i + 3], PRIOR_ON_POOR) for i in at))
    return model


def score(df: DataFrame, text: str, keep: list[str] | None = None,
          rules: list[Rule] | None = None) -> DataFrame:
    """Attach the counts, base_failed, quality (posterior) and kept.

    ``keep`` names the columns to carry besides (default: all).
    """
    rules = rules or RULES
    stats = text_stats(df, text)
    carried = [c for c in (df.columns if keep is None else keep)
               if c not in (*STATS, "base_failed", "quality", "kept")]
    stats = stats.select(*carried, *STATS, "base_failed")
    names = fresh(stats, *[f"_vote{i}" for i in range(len(rules))])
    voted = materialise(stats.withColumns({n: F.expr(vote(r)) for n, r in zip(names, rules)}))
    model = fit(voted.select(*names), names)
    return (
        voted.withColumn("quality", model.posterior([F.col(n) for n in names]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
        .drop(*names)
    )


def keep_good(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns.

    The counts of a row are a pure function of its text, so the votes are worked
    out once for the label model and once more in the row; no text is shuffled.
    """
    names = [f"_vote{i}" for i in range(len(RULES))]
    stats = [F.col(c) for c in (*STATS, "base_failed")]
    voted = text_stats(df.select(F.col(text)), text).select(*stats)
    voted = materialise(voted.select(*[F.expr(vote(r)).alias(n) for n, r in zip(names, RULES)]))
    model = fit(voted, names)
    row, inner = fresh(df, "_row", "_text")
    boxed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias(row),
                      F.col(text).alias(inner))
    boxed = text_stats(boxed, inner).withColumns({
        n: F.expr(vote(r)) for n, r in zip(names, RULES)})
    # the id keeps the planner from moving the filter below the counts and working each out
    # again inside the other's lambdas
    boxed = boxed.withColumn("_stay", F.monotonically_increasing_id())
    good = boxed.where((F.col("_stay") >= 0) & ~F.col("base_failed")
                       & (model.posterior([F.col(n) for n in names]) >= KEEP_AT))
    return good.select(*[F.col(row)[c].alias(c) for c in df.columns])
