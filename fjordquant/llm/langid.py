"""Language identification with interpolated Kneser-Ney character models.

Characters are folded to 64 symbols (a non-letter is a space, runs of spaces are
one, a-z are themselves, other letters share the remaining symbols by code point),
so a model holds 2^24 four-grams per language at most, whatever the corpus.  Tasks
count four-grams of all training rows, Spark adds the counts up, and the summed
table becomes sorted key arrays with one column of log-probabilities per language.
A text's language is that of the lowest cross-entropy per symbol.  Scores and the
rejection limits are calibrated on every training row: the rows are dealt into folds, and
each fold is scored by a model of the others.  The model that is returned counts all of
them.  Counts reach the driver one fold at a time and scores not at all, only their
quantiles and means.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; ties go to the first language by name; a table without labels gives
``und`` throughout; a language that no other fold predicts rightly is never
rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordquant.functions.ordering import grouped_quantiles
from fjordquant.llm import textscan as S
from fjordquant.llm.common import fresh
from fjordquant.session import materialise

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
FOLDS = 5
CALIBRATION_ROWS = 20_000  # scored rows that the driver reads; more are aggregated by Spark
BINS = 12
REJECT_QUANTILE = 0.999
REJECT_SLACK = 1.5
REJECT_FLOOR = 0.5         # nats per symbol above a language's mean that always pass
SHORT = 40.0               # texts of about this many symbols vary twice as much
MERGE_EVERY = 24
SLICE_BYTES = 1 << 18      # text worked on at once; its arrays take some 60 bytes a symbol
UNKNOWN = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point; letters and marks are above 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


def gram_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the four-grams ending at each symbol, where each text's begin)."""
    data, at = S.text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    chars = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), at)
    # three spaces after every text keep the next one's contexts clean
    pad = 3
    texts = len(column)
    owner_first = chars[:-1] + pad * np.arange(texts)
    symbol = np.zeros(len(points) + pad * texts, np.uint8)
    place = np.arange(len(points)) + pad * np.repeat(np.arange(texts), np.diff(chars))
    symbol[place] = symbol_table()[points]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    if len(keep):
        keep[0] = symbol[0] != 0
    # of the padding, the first space after a letter is predicted; then two more are kept
    tail = (owner_first[:, None] + np.diff(chars)[:, None] + np.arange(1, pad)).ravel()
    pads = np.zeros(len(symbol), bool)
    pads[tail] = True
    keep |= pads
    kept = symbol[keep].astype(np.uint32)
    predicted = ~pads[keep]
    codes = kept.copy()
    for k in range(1, ORDER):
        codes[k:] |= kept[:-k] << np.uint32(BITS * k)
    first = np.concatenate([[0], np.cumsum(keep)])[np.append(owner_first, len(symbol))]
    seen = np.concatenate([[0], np.cumsum(predicted)])
    return codes[predicted], seen[first]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Small pieces of the batches.  Workers outlive their tasks, so what the last piece
    held goes back to the system."""
    yield from S.slices(batches, text, SLICE_BYTES)
    pa.default_memory_pool().release_unused()


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang), summed in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}

        def merged(items: list) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in items]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in items])).astype(np.int64)

        for batch in slices(batches, "text"):
            codes, first = gram_codes(batch.column(0))
            names, which = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str),
                                     return_inverse=True)
            label = np.repeat(which, np.diff(first))
            for i, name in enumerate(names):
                keys, n = np.unique(codes[label == i], return_counts=True)
                own = parts.setdefault(str(name), [])
                own.append((keys, n))
                if len(own) >= MERGE_EVERY:
                    own[:] = [merged(own)]
            del batch
        for name, own in parts.items():
            keys, n = merged(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int32)),
                 pa.array(n)], ["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    log_seen: np.ndarray | None = None   # languages x keys: log p of a stored four-gram
    lower: np.ndarray | None = None      # languages x 2^18: p of the three-gram
    back: np.ndarray | None = None       # languages x 2^18: weight of the lower order

    def entropies(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Languages x texts: mean negative log-probability per symbol."""
        at = np.searchsorted(self.keys, codes)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == codes
        miss = np.flatnonzero(~hit)
        mask = np.uint32((1 << BITS * (ORDER - 1)) - 1)
        tail, context = codes[miss] & mask, codes[miss] >> np.uint32(BITS)
        size = np.maximum(np.diff(first), 1)
        out = np.empty((len(self.languages), len(size)))
        for i in range(len(self.languages)):
            value = self.log_seen[i][at]
            value[miss] = np.log(self.back[i][context] * self.lower[i][tail])
            total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            out[i] = -(total[first[1:]] - total[first[:-1]]) / size
        return out


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def interpolated(codes: np.ndarray, counts: np.ndarray, below: np.ndarray, order: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(own part of every code, weight of the lower order of every context)."""
    d = discount(counts)
    contexts = 1 << BITS * (order - 1)
    context = (codes >> BITS).astype(np.int64)
    total = np.bincount(context, counts, contexts)
    types = np.bincount(context, minlength=contexts)
    back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / total[context], back


def kneser_ney(languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of (codes, counts) per language."""
    keys = np.unique(np.concatenate([c for c, _ in tables])) if tables else np.zeros(0, np.uint32)
    n_lower = 1 << BITS * (ORDER - 1)
    log_seen = np.zeros((len(languages), len(keys)), np.float32)
    lower, back = np.zeros((2, len(languages), n_lower), np.float32)
    for i, (codes, counts) in enumerate(tables):
        probability = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for order in range(1, ORDER):
            # how many different symbols precede each shorter gram
            size = 1 << BITS * order
            types = codes
            for longer in range(ORDER, order + 1, -1):
                types = np.unique(types & np.uint32((1 << BITS * (longer - 1)) - 1))
            before = np.bincount((types & np.uint32(size - 1)).astype(np.int64), minlength=size)
            own = np.flatnonzero(before)
            part, weight = interpolated(own, before[own].astype(float), probability, order)
            tail = np.arange(size) & ((1 << BITS * max(order - 1, 1)) - 1)
            value = weight[np.arange(size) >> BITS] * probability[tail]
            value[own] += part
            probability = value
        part, weight = interpolated(codes.astype(np.int64), counts.astype(float), probability, ORDER)
        lower[i], back[i] = probability, weight
        full = weight[(keys >> np.uint32(BITS)).astype(np.int64)] * probability[
            (keys & np.uint32(n_lower - 1)).astype(np.int64)]
        full[np.searchsorted(keys, codes)] += part
        log_seen[i] = np.log(full)
    return Model(languages, keys, log_seen, lower, back)


@dataclass
class Calibration:
    """Right-share by likelihood gap, and the cross-entropy limit of each language."""

    edges: list[float]
    share: list[float]
    mean: dict[str, float]
    limit: dict[str, float]

    def score(self, gap: np.ndarray) -> np.ndarray:
        return np.array(self.share)[np.searchsorted(self.edges, gap)]

    def excess(self, lang: str, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (entropy - self.mean[lang]) / np.sqrt(1 + SHORT / np.maximum(size, 1))

    def accepts(self, lang: str, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        if lang not in self.mean:
            return np.ones(len(size), bool)
        return self.excess(lang, entropy, size) <= self.limit[lang]


def calibrate(sample: list[tuple]) -> Calibration:
    """From (true language, predicted, gap, entropy, symbols) of the scored rows."""
    if not sample:
        return Calibration([], [0.5], {}, {})
    gap = np.array([s[2] for s in sample])
    right = np.array([s[0] == s[1] for s in sample])
    edges = sorted(set(np.quantile(gap, np.linspace(0, 1, BINS + 1)[1:-1]).tolist()))
    place = np.searchsorted(edges, gap)
    n = np.bincount(place, minlength=len(edges) + 1)
    hits = np.bincount(place, right, len(edges) + 1)
    share = np.maximum.accumulate((hits + 1) / (n + 2))
    own: dict[str, list[tuple]] = {s[0]: [] for s in sample if s[0] == s[1]}
    for s in sample:
        if s[1] in own:
            own[s[1]].append(s)
    mean = {x: float(np.mean([s[3] for s in rows])) for x, rows in own.items()}
    flat = Calibration(edges, share.tolist(), mean, {})
    excess = {x: [float(flat.excess(x, s[3], s[4])) for s in rows] for x, rows in own.items()}

    if own:
        common = reject_limit(np.quantile([v for e in excess.values() for v in e], REJECT_QUANTILE))
        flat.limit = {x: max(common, reject_limit(np.quantile(e, REJECT_QUANTILE)))
                      for x, e in excess.items()}
    return flat


def reject_limit(quantile: float) -> float:
    return max(float(quantile) * REJECT_SLACK, REJECT_FLOOR)


def calibrate_rows(scored: DataFrame) -> Calibration:
    """As ``calibrate``, from a table (lang, lang_pred, gap, entropy, symbols) of any size."""
    rows = scored.withColumn("_all", F.lit(1))
    cuts = grouped_quantiles(rows, ["_all"], "gap", {
        f"q{i}": i / BINS for i in range(1, BINS)}).first()
    if cuts is None:
        return calibrate([])
    edges = sorted({cuts[f"q{i}"] for i in range(1, BINS)})
    right = (F.col("lang") == F.col("lang_pred")).cast("long")
    place = sum(((F.col("gap") > e).cast("int") for e in edges), F.lit(0))
    n, hits = np.zeros((2, len(edges) + 1))
    for r in rows.groupBy(place.alias("place")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(right).alias("hits")).collect():
        n[r["place"]], hits[r["place"]] = r["n"], r["hits"]
    share = np.maximum.accumulate((hits + 1) / (n + 2))
    mean = {r["lang_pred"]: r["mean"] for r in rows.groupBy("lang_pred").agg(
        F.avg("entropy").alias("mean"), F.sum(right).alias("hits")).where("hits > 0").collect()}
    out = Calibration(edges, share.tolist(), mean, {})
    if not mean:
        return out
    means = F.create_map(*[F.lit(x) for pair in mean.items() for x in pair])
    own = rows.where(F.col("lang_pred").isin(*mean)).withColumn(
        "excess", (F.col("entropy") - means[F.col("lang_pred")]) / F.sqrt(
            1 + F.lit(SHORT) / F.greatest("symbols", F.lit(1))))
    q = {"q": REJECT_QUANTILE}
    common = reject_limit(grouped_quantiles(own, ["_all"], "excess", q).first()["q"])
    out.limit = {r["lang_pred"]: max(common, reject_limit(r["q"]))
                 for r in grouped_quantiles(own, ["lang_pred"], "excess", q).collect()}
    return out


def predict(df: DataFrame, text: str, model: Model, calibration: Calibration | None
            ) -> DataFrame:
    """Attach lang_pred, score, accepted, and the raw gap, entropy and symbol count."""
    return predict_shared(df, text, df.sparkSession.sparkContext.broadcast((model, calibration)))


def predict_shared(df: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """As ``predict``, by a broadcast (model, calibration) that the caller may destroy."""
    clean = df.drop("lang_pred", "score", "accepted", "gap", "entropy", "symbols")
    letters = fresh(clean, "_letters")[0]
    source = clean.select(*clean.columns, has_letter(F.col(text)).alias(letters))
    place = clean.columns.index(text)
    schema = clean.schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("accepted", "boolean"),
                       ("gap", "double"), ("entropy", "double"), ("symbols", "long")):
        schema = schema.add(name, kind)
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, calibration = shared.value
        for batch in slices(batches, text):
            codes, first = gram_codes(batch.column(place))
            size = np.diff(first)
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            known = known.astype(bool) & bool(model.languages)
            entropy = np.zeros(len(size))
            gap, score = np.zeros(len(size)), np.zeros(len(size))
            names = np.full(len(size), UNKNOWN, object)
            accepted = known.copy()
            if model.languages:
                all_of = model.entropies(codes, first)
                best = all_of.argmin(0)
                entropy = all_of.min(0)
                if len(all_of) > 1:
                    gap = (np.partition(all_of, 1, 0)[1] - entropy) * size
                names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                if calibration is not None:
                    score = np.where(known, calibration.score(gap), 0.0)
                    for name in model.languages:
                        own = names == name
                        accepted[own] &= calibration.accepts(name, entropy[own], size[own])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names.tolist(), pa.string()), pa.array(score),
                 pa.array(accepted), pa.array(gap), pa.array(entropy),
                 pa.array(size.astype(np.int64))],
                out_names)
            del batch

    return source.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows that no model learns from; rows without an id are among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(df: DataFrame, key: str, text: str, lang: str) -> tuple[Model, Calibration]:
    """Fit and calibrate on all labelled rows that are not held out."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .where(~held_out(F.col("key")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    fold = F.pmod(F.xxhash64("key", "text"), F.lit(FOLDS)).cast("int")
    # at most 2^24 rows a fold and language by construction of the symbols
    counted = materialise(count_grams(rows.withColumn("lang", F.concat(
        fold.cast("string"), F.lit(":"), F.col("lang")))))
    parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(FOLDS):
        table = counted.where(F.col("lang").startswith(f"{k}:")).toArrow()
        names = table.column("lang").combine_chunks().dictionary_encode()
        which = names.indices.to_numpy(zero_copy_only=False)
        grams = table.column("gram").to_numpy().astype(np.uint32)
        counts = table.column("n").to_numpy()
        for i, name in enumerate(names.dictionary.to_pylist()):
            parts.setdefault(name.split(":", 1)[1], {})[k] = grams[which == i], counts[which == i]

    def fitted(left_out: int | None) -> Model:
        languages, tables = [], []
        for name in sorted(parts):
            own = [t for k, t in parts[name].items() if k != left_out]
            if own:
                keys, where = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in own]), len(keys))
                languages.append(name)
                tables.append((keys, n.astype(np.int64)))
        return kneser_ney(languages, tables)

    model, scored = fitted(None), None
    for k in sorted({k for own in parts.values() for k in own}):
        others = fitted(k)
        if others.languages:
            shared = df.sparkSession.sparkContext.broadcast((others, None))
            part = materialise(predict_shared(rows.where(fold == k), "text", shared).select(
                "lang", "lang_pred", "gap", "entropy", "symbols"))
            shared.destroy()  # its rows are written; else every fold's model stays in the executors
            scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return model, calibrate([])
    if scored.count() > CALIBRATION_ROWS:
        return model, calibrate_rows(scored)
    return model, calibrate([tuple(r) for r in scored.collect()])


def identify(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Train on the labelled rows of ``df`` and predict all of them."""
    model, calibration = train(df, key, text, lang)
    return predict(df, text, model, calibration)
