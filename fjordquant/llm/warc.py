"""WARC archives: writing with revisit records, reading by boundary chains.

Writing.  Records are the lines of Spark text files whose line separator is the
blank line that ends a WARC record, so any store that Spark reaches will do and a
lost task writes its file again.  Equal payloads of MIN_REVISIT bytes or more are
stored once; the others become revisit records.

Reading.  Files are cut at every occurrence of the version line, also inside
payloads.  Tasks turn each piece into a candidate with its successor's offset
(header + Content-Length); inside a segment of a file pointer jumping gives each
candidate its exit from the segment, doubling over the segments from the start of
the file gives each segment's true entry, and only candidates reachable from there
are records.  Pieces inside a record's payload are joined back to it.

Edge cases: null payloads are empty; repeated page ids are separate records, and
those with the largest id of a group are all responses; a payload may hold the
version line or whole records; a broken tail after the last record is left out;
an empty table writes no record and reads as empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordquant.session import checkpoint_root, materialise

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
BROADCAST_ROWS = 1_000_000   # revisit rows sent to all tasks (about 64 MB); beyond, a join
SEGMENT = 64 << 20           # bytes of a file whose candidates are chained in one task
RECORDS_PER_FILE = 200_000
DATE = "2024-01-01T00:00:00Z"


# ---------------------------------------------------------------- writing
def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the rows whose payload another row stores."""
    long = rows.where(F.col("payload_bytes") >= MIN_REVISIT)
    stored = long.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return long.join(stored, ["payload_digest", "payload_bytes"]).where(
        "page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def records(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """One string per record, without the blank line that ends it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]", " ").alias("url"),
        body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"))
    table = materialise(revisits(rows.drop("payload", "url")))
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(table) if few else table, ["page_id", "payload_digest"], "left")
    again = F.col("refers_to").isNotNull()
    content = F.when(again, "").otherwise(F.col("payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    return joined.select(F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, line("WARC-Refers-To", name(F.col("refers_to")))).otherwise(""),
        line("Content-Length", F.octet_length(content).cast("string")),
        F.lit("\r\n"), content).alias("value"))


def write(pages: DataFrame, page_id: str, url: str, payload: str, path: str) -> None:
    records(pages, page_id, url, payload).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/warc/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- reading
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Payload-Length",
          "WARC-Refers-To", "WARC-Target-URI"]
PIECE = ("file string, block long, seq long, local long, size long, head long, content long, "
         "fields array<string>, digest string")


def header(piece: bytes) -> tuple[int, int, list[str | None]] | None:
    """(header bytes after the version line, Content-Length, FIELDS) or None."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    found: dict[bytes, str] = {}
    for line in piece[:stop].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        found[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = found.get(b"content-length", "")
    if not length.isdigit() or b"warc-type" not in found:
        return None
    return stop + 4, int(length), [found.get(f.lower().encode()) for f in FIELDS]


def raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, in file order inside each partition."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with the bytes before them in their block; digests of whole payloads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, local, seq = None, 0, 0
        for batch in batches:
            out = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != where:
                    where, local, seq = (file, block), 0, 0
                # a file's first piece is what stands before its first version line
                parsed = header(value)
                head, content, fields = parsed or (-1, -1, None)
                digest = None
                if parsed and head + content + len(END) == len(value):
                    digest = hashlib.sha1(value[head:head + content]).hexdigest()
                out.append((file, block, seq, local, len(value), head, content, fields, digest))
                local += len(value) + len(MAGIC)
                seq += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                    pa.int64(), pa.list_(pa.string()), pa.string()))] if out else
                [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                           pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())],
                ["file", "block", "seq", "local", "size", "head", "content", "fields", "digest"])

    return raw_pieces(spark, path).mapInArrow(run, PIECE)


def with_offsets(found: DataFrame) -> DataFrame:
    """Attach each piece's offset: where its version line begins in the file."""
    ends = found.groupBy("file", "block").agg(
        F.max(F.col("local") + F.col("size") + len(MAGIC)).alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "block", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    return found.join(starts, ["file", "block"]).withColumn(
        "offset", F.col("_start") + F.col("local") - len(MAGIC)).drop("_start")


def _chain(offset: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each candidate's successor (its own if none), sorted offsets assumed."""
    at = np.searchsorted(offset, successor)
    at[at == len(offset)] = 0
    good = (successor > offset) & (offset[at] == successor)
    return np.where(good, at, np.arange(len(offset))), good


def segment_exits(pdf):
    """Exit of every candidate from its segment by pointer jumping."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    jump, _ = _chain(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    pdf["exit"] = pdf["successor"].to_numpy()[jump]
    return pdf[["file", "segment", "offset", "exit"]]


def segment_walk(pdf):
    """Candidates that the segment's entry reaches."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    offset = pdf["offset"].to_numpy()
    jump, _ = _chain(offset, pdf["successor"].to_numpy())
    reached = offset == pdf["entry"].to_numpy()
    while True:  # the reached set doubles with every jump
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    return pdf.loc[reached, ["file", "offset"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from each file's start."""
    nodes = candidates.select("file", "offset", "successor", F.floor(
        F.col("offset") / SEGMENT).cast("long").alias("segment"))
    exits = materialise(nodes.groupBy("file", "segment").applyInPandas(
        segment_exits, "file string, segment long, offset long, exit long"))
    # doubling: jump maps an entry of a segment to the entry 2^k segments on
    entries = materialise(exits.where("offset = 0").select("file", "offset"))
    jump = exits.select("file", "offset", F.col("exit").alias("to"))
    while True:
        ahead = entries.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        grown = materialise(entries.union(
            ahead.join(exits.select("file", "offset"), ["file", "offset"], "left_semi")).distinct())
        if grown.count() == entries.count():
            break
        entries = grown
        jump = materialise(jump.join(jump.select(
            "file", F.col("offset").alias("to"), F.col("to").alias("next")), ["file", "to"]).select(
            "file", "offset", F.col("next").alias("to")))
    entry = entries.withColumn("segment", F.floor(F.col("offset") / SEGMENT).cast("long")).groupBy(
        "file", "segment").agg(F.min("offset").alias("entry"))
    return nodes.join(entry, ["file", "segment"]).groupBy("file", "segment").applyInPandas(
        segment_walk, "file string, offset long")


def long_payloads(spark: SparkSession, path: str, found: DataFrame, heads: DataFrame) -> DataFrame:
    """(file, offset, digest, missing) of records whose payload holds version lines."""
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.join(heads.select("file", "offset", F.col("successor").alias("_stop"),
                                     F.col("offset").alias("_at")), ["file", "offset"], "left")
    inside = marked.withColumn("owner", F.last("_at", True).over(order)).withColumn(
        "stop", F.last("_stop", True).over(order)).where("owner IS NOT NULL AND offset < stop").select(
        "file", "block", "seq", "offset", "owner")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, seq = None, 0
        for batch in batches:
            numbers = []
            for file, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, block) != where:
                    where, seq = (file, block), 0
                numbers.append(seq)
                seq += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64())], ["value", "file", "block", "seq"])

    again = raw_pieces(spark, path).mapInArrow(number, "value binary, file string, block long, seq long")

    def assemble(pdf):
        pdf = pdf.sort_values("offset")
        whole = MAGIC.encode().join(pdf["value"])
        head, content, _ = header(whole)
        body = whole[head:head + content]
        pdf = pdf.head(1)[["file", "owner"]].rename(columns={"owner": "offset"})
        pdf["long_digest"] = hashlib.sha1(body).hexdigest() if len(body) == content else None
        return pdf

    return inside.join(again, ["file", "block", "seq"]).groupBy("file", "owner").applyInPandas(
        assemble, "file string, offset long, long_digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, url, payload_bytes, payload_digest) of all records.

    The digest of a response is worked out from its payload as read.
    """
    found = materialise(with_offsets(pieces(spark, path)))
    candidates = found.where("head >= 0").withColumn(
        "successor", F.col("offset") + len(MAGIC) + F.col("head") + F.col("content") + len(END))
    chained = materialise(candidates.join(reachable(candidates), ["file", "offset"], "left_semi"))
    heads = chained.where("digest IS NULL")
    if heads.limit(1).count():
        chained = chained.join(long_payloads(spark, path, found, heads), ["file", "offset"], "left") \
            .withColumn("digest", F.coalesce("digest", "long_digest"))
    field = lambda name: F.get("fields", F.lit(FIELDS.index(name)))
    page = lambda c: F.expr(f"try_cast(regexp_extract(fields[{FIELDS.index(c)}], '<urn:page:(-?[0-9]+)>', 1) AS long)")
    is_response = field("WARC-Type") == "response"
    return chained.where("digest IS NOT NULL").select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"),
        F.when(~is_response, page("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.when(is_response, F.col("content")).otherwise(
            field("WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(is_response, F.col("digest")).otherwise(
            F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"))
