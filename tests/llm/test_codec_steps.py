"""What encoding and decoding leave out, with the same results."""

import base64
from types import SimpleNamespace

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")


def test_letters_alone_are_not_cut(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v, asked = bpe.vocabulary(open(FILE, "rb").read(), P.PATTERN), []
    counted = SimpleNamespace(findall=lambda t: asked.append(t) or v.pattern.findall(t))
    monkeypatch.setattr(bpe, "vocabulary", lambda *_: SimpleNamespace(pattern=counted, piece=v.piece))
    memory = bpe.remembered.__wrapped__(b"", "")
    text = "größerer Ausblickender qwertzuiopa, don't a1b2 x\ny zuletzt"
    assert list(memoryview(memory.encode([text])[0]).cast("i")) == library.encode_ordinary(text)
    assert asked and not any(t.strip().isalpha() for t in asked if "'" not in t)


def test_decode_of_rows_without_ids_and_of_unknown_ones(spark):
    d = spark.createDataFrame([(1, [64, 220, 275]), (2, None), (3, []), (4, [50255]), (5, None)], "n long, ids array<int>").coalesce(1)
    want = bpe.vocabulary(open(FILE, "rb").read(), P.PATTERN)
    got = {r["n"]: r["decoded"] for r in bpe.decode(d, FILE, P.PATTERN).collect()}
    assert got[2] is None and got[5] is None and {n: bytes(got[n]) for n in (1, 3, 4)} == {1: want.decode([64, 220, 275]), 3: b"", 4: want.decode([50255])}
    for bad in (60_000, -1):
        with pytest.raises(PySparkException):
            bpe.decode(d.withColumn("ids", F.array(F.lit(bad))), FILE, P.PATTERN).collect()
