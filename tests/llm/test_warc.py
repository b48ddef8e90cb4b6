import hashlib

from fjordquant.llm import warc as W


def want(rows):
    groups = {}
    for i, _, p in rows:
        b = (p or "").encode()
        if len(b) >= 1000:
            groups[b] = max(groups.get(b, -1), i)
    out = []
    for i, _, p in rows:
        b = (p or "").encode()
        top = groups.get(b)
        again = top is not None and i < top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
                    top if again else None))
    return sorted(out, key=str)


def rows():
    record = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc")
    out = [(i, f"u{i}", f"<p>{i} é " + "x" * (i * 37 % 900) + "</p>") for i in range(60)]
    out += [(100 + i, "dup", "same " * 400) for i in range(20)]
    out += [(200, None, None), (201, "short", "short"), (202, "short", "short"), (203, "a\r\nb", "")]
    out += [(300, "magic", "WARC/1.1\r\n"), (301, "two", "x" + "WARC/1.1\r\n" * 3 + "y"),
            (302, "whole", record + "\r\n\r\n" + record + "\r\n\r\n"), (303, "tail", "text\r\n\r\n" + record),
            (304, "lines", "\r\n\r\n\r\n\r\nWARC/1.1"), (305, "bad", "WARC/1.1\r\nno header\r\n\r\n")]
    return out


def got(spark, data, path):
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    W.write(df.repartition(2), "page_id", "url", "html", path)
    return sorted((tuple(r) for r in W.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    assert got(spark, rows(), f"{tmp_path}/a") == want(rows())


def test_small_blocks_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT", 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert got(spark, rows(), f"{tmp_path}/b") == want(rows())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_ids_and_empty(spark, tmp_path):
    data = [(1, "u", "z" * 2000), (1, "u", "z" * 2000), (0, "u", "z" * 2000)]
    assert got(spark, data, f"{tmp_path}/c") == want(data)
    assert got(spark, [], f"{tmp_path}/d") == []
