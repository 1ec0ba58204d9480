"""Token records and byte-level BPE against the libraries."""

import base64
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from touchline.llm import bpe, records
from touchline.llm.chunks import chunks
from touchline.session import scratch

FILE = P.path("byte_bpe_50k.tiktoken")
BITS = ["a", " ", "\n", "'s", "'", "é", "1", "  ", "\t", "the", "!", "日本", "\x1c", "_", "<|endoftext|>", "aaaaaa", "　", "Word", " word"]
SCHEMA = "doc_id long, text string, ids string, decoded long, h int"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(FILE, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(BITS, k=r.randint(0, 15))) for _ in range(n)]


def docs(spark, extra=()):
    rows = [(i, t) for i, t in enumerate(texts(40))] + [(None, "no id"), (50, None), (51, ""), (51, ""), (52, "x" * 30_000 + " end"), *extra]
    return rows, spark.createDataFrame([(i, t, "ids", 1, 2) for i, t in rows], SCHEMA)


def test_encoding_equals_the_library(vocabulary, library):
    memory = bpe.remembered(open(FILE, "rb").read(), P.PATTERN)
    ts = texts(3000)
    for t, whole in zip(ts, memory.encode(ts), strict=True):
        want = library.encode_ordinary(t)
        assert vocabulary.encode(t) == want == np.frombuffer(whole, "<i4").tolist()
        assert vocabulary.decode(want) == t.encode()


def test_a_small_memory_gives_the_same(library):
    memory = bpe.remembered(open(FILE, "rb").read(), P.PATTERN)
    memory.most = 5
    for t in texts(200, 9):
        assert np.frombuffer(memory.encode([t])[0], "<i4").tolist() == library.encode_ordinary(t)
    memory.most = 800_000


def test_chunks_put_together_are_the_text():
    for t in texts(2000, 5):
        plain, spaced = chunks(t)
        assert "".join([*plain, *(" " + w for w in spaced)]) == t


def test_edits_and_appends(vocabulary, library):
    r = random.Random(4)
    for t in texts(300, 6):
        e = bpe.Editable(vocabulary, t)
        for _ in range(4):
            a = r.randint(0, len(e.text))
            e.edit(a, r.randint(a, min(len(e.text), a + 3)), "".join(r.choices(BITS, k=r.randint(0, 3))))
            assert e.ids() == library.encode_ordinary(e.text)
        e.append(" more")
        assert e.ids() == library.encode_ordinary(e.text)


def test_bpe_over_a_table(spark, library):
    rows, d = docs(spark)
    out = bpe.decode(bpe.encode(d, FILE, P.PATTERN), FILE, P.PATTERN).select("doc_id", "text", "ids", "decoded", "h").collect()
    assert sorted((str(i), t or "") for i, t in rows) == sorted((str(r["doc_id"]), r["text"] or "") for r in out)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and r["h"] == 2
    assert bpe.encode(d.limit(0), FILE, P.PATTERN).count() == 0


def test_records_round_trip(spark):
    rows, d = docs(spark)
    path = scratch(spark, "records")
    manifest = records.write(d, path, P.path("byte_bpe_50k.json"), shards=3)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, start, zlib.crc32(ids)))
        start += len(ids) // 4
    key = lambda r: (r[1],)
    assert sorted(((r["id"], r["start"], zlib.crc32(r["ids"])) for r in records.read(spark, path).collect()), key=key) == want
    shuffled = [(r["id"], r["start"], zlib.crc32(r["ids"])) for r in records.read_shuffled(spark, path, seed=5, tasks=2).collect()]
    assert sorted(shuffled, key=key) == want != shuffled


def test_special_tokens_as_the_library_does():
    source = open(P.path("byte_bpe_50k.json")).read()
    t = Tokenizer.from_str(source)
    ts = [*texts(3000, 12), "a <|endoftext|> b", "a<|endoftext|>. b", "x  <|endoftext|>\n", "end <|endoftext|>,"]
    for x, got in zip(ts, records.tokenizer(source, True).encode(ts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_op1_keeps_special_tokens(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert records.op1_token_records(spark, path).first()["n_tokens"] == 5


def test_no_records(spark):
    path = scratch(spark, "records")
    records.write(docs(spark)[1].limit(0), path, P.path("byte_bpe_50k.json"))
    assert records.read(spark, path).count() == 0


def test_damage_is_noticed():
    r = records.frame(7, np.array([1, 2, 70_000], "<u4"))
    assert records.parse(r)[0] == 7 and records.parse(r)[1].tolist() == [1, 2, 70_000]
    for k in range(len(r)):
        with pytest.raises(ValueError):
            records.parse(r[:k] + bytes([r[k] ^ 1]) + r[k + 1:])
    assert records.parse(records.frame(None, np.array([], "<u4")))[0] is None
