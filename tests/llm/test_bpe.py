import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from fjordquant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LINES = open(PATH, "rb").read().splitlines()
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in LINES)}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                              special_tokens={})
HARD = [
    "", " ", "  ", "\n", " \n", "\n ", "a", " a", "  a", "\n a", "a  ", "it's", " 's", "''s", "'s's", "'re'",
    "'r", "'l", "'ll", "x'LL", "we've  been\t\tthere  x", "　　日本語 123４ ٣", "é́'m", "'", "''",
    "😀 😀😀'd", "a\r\n\r\nb", "<|endoftext|>", "\x00\x01", "Ⅷ½²", "​ x", "x" * 3000, "ab" * 2000,
    " " * 5000 + "z", "don't'll've",
]


def texts(seed):
    rng = random.Random(seed)
    alphabet = list("  \n\t'''strevlmdab1é٣日😀.,! 　")
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
                   for _ in range(3000)]


def test_ids_equal_the_library():
    cases = texts(3)
    encoder = bpe.Encoder(RANKS)
    data, at = bpe.token_bytes(RANKS)
    packed, ends = bpe.encode_slice(pa.array(cases), encoder, np.diff(at))
    for text, ids, end in zip(cases, packed, ends):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text), repr(text)
        assert bpe.decode_ids(ids, data, at) == text.encode()
        stops = [0, *np.frombuffer(end, "<u4").tolist()]
        assert stops[-1] == len(text.encode())


def test_block_edges_do_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3)
    test_ids_equal_the_library()


def test_query_on_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(4)[:300])] + [(7, None, "y"), (7, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.digests(df, "doc_id", "text", bpe.load_vocabulary(spark, PATH)).collect()
    want = sorted((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, _ in rows for ids in [REFERENCE.encode_ordinary(t or "")])
    assert sorted(map(tuple, got)) == want
    assert bpe.digests(df.limit(0), "doc_id", "text", bpe.load_vocabulary(spark, PATH)).count() == 0
