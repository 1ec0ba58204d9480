"""Token ids as length-delimited binary records with an offset index.

A folder holds shards `shard-NNNNN.bin` in ascending order of document id, an
index `shard-NNNNN.idx` beside each, and a manifest (Parquet, one row per shard).

    record  = u64 length, u32 masked crc of the length, payload, u32 masked crc of the payload
    payload = u8 flags (1: has an id; 2: ids of four bytes, else two), i64 document id, token ids
    index   = per record: u64 offset, u64 length of the record, u64 ids before it in the shard

All little-endian.  The crc is CRC-32 as of zlib, masked by rotating it right by 15
bits and adding 0xA282EAD8, so that the checksum of data that holds checksums
stays telling.  With the index a reader can fetch records in any order.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.chunks import Remembered, slices
from touchline.llm.common import documents, inner, running_before
from touchline.session import scratch

HEAD, CRC, PAYLOAD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQQ")
HAS_ID, WIDE = 1, 2
#: Bytes that a reader hands on at once.
BATCH_BYTES = 1 << 23
FOUND = "id long, shard long, start long, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = PAYLOAD.pack((doc_id is not None) * HAS_ID | wide * WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    return b"".join((HEAD.pack(len(body), masked(struct.pack("<Q", len(body)))), body, CRC.pack(masked(body))))


def entry(offset: int, length: int, before: int) -> bytes:
    return ENTRY.pack(offset, length, before)


def parse(record: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one record; an error if a checksum is wrong."""
    n, crc = HEAD.unpack_from(record)
    body = record[HEAD.size:HEAD.size + n]
    if crc != masked(record[:8]) or len(record) != HEAD.size + n + CRC.size or CRC.unpack_from(record, HEAD.size + n)[0] != masked(body):
        raise ValueError("damaged record")
    flags, doc_id = PAYLOAD.unpack_from(body)
    return doc_id if flags & HAS_ID else None, np.frombuffer(body, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size).astype("<u4")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there; the executors write to it directly."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def name(shard: int, kind: str) -> str:
    return f"shard-{shard:05d}.{kind}"


@functools.lru_cache(maxsize=2)
def tokenizer(source: str, special: bool = False) -> Remembered:
    """Encodes as the library does; `special`: the strings of added special tokens become their ids, as is its default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.encode_special_tokens = not special  # if so, their strings are ordinary text

    def fresh(new: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(new, add_special_tokens=False)]

    return Remembered(fresh)


def write(docs: DataFrame, path: str, tokenizer_file: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, special: bool = False) -> DataFrame:
    """Encode every text, add `end` to each and write the records; returns the manifest.

    Documents go to shards by ranges of (id, hash of the text), null ids first;
    equal rows are in no particular order, which can't be told from outside.
    `shards` defaults to Spark's number of shuffle partitions; an empty shard has
    no files.  Null texts count as empty.  A task writes its shard under a name of
    its own attempt and renames it when it is whole, so a task that is lost or
    runs twice leaves the same files.  With `special`, the strings of special tokens
    in a text are encoded as these, as the library does by default.
    """
    spark = docs.sparkSession
    with open(tokenizer_file) as f:
        source = spark.sparkContext.broadcast(f.read())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        files.create_dir(folder, recursive=True)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        own = {k: f"{folder}/.{name(shard, k)}.{attempt}" for k in ("bin", "idx")}
        out, at, count, tokens = None, 0, 0, 0
        last = [] if end is None else [np.array([end], "<u4")]
        for b in batches:
            ids = iter(b.column("id").to_pylist())
            for some in slices(b.column("text")):
                if out is None:
                    out = [files.open_output_stream(own[k]) for k in own]
                block, places = [], []
                for raw in tokenizer(source.value, special).encode(some):
                    seq = np.concatenate([np.frombuffer(raw, "<u4"), *last])
                    block.append(r := frame(next(ids), seq))
                    places.append(entry(at, len(r), tokens))
                    at, count, tokens = at + len(r), count + 1, tokens + len(seq)
                out[0].write(b"".join(block))
                out[1].write(b"".join(places))
        if out is not None:
            for stream, (k, tmp) in zip(out, own.items(), strict=True):
                stream.close()
                files.move(tmp, f"{folder}/{name(shard, k)}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [count], "tokens": [tokens], "bytes": [at]})

    rows = inner(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    dealt = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    manifest = f"{path}/manifest"
    dealt.select("id", "text").mapInArrow(put, "shard long, records long, tokens long, bytes long").write.parquet(manifest)
    return spark.read.schema("shard long, records long, tokens long, bytes long").parquet(manifest)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with `before`, the ids in all shards before; one task per shard."""
    m = spark.read.schema("shard long, records long, tokens long, bytes long").parquet(f"{path}/manifest")
    n = max(1, m.count())
    return m.join(running_before(m, "shard", "tokens", "before"), "shard").select("shard", "before").repartition(n)


def entries(path: str, shard: int) -> np.ndarray:
    """The index of one shard: rows of offset, length, ids before."""
    files, folder = store(path)
    with files.open_input_stream(f"{folder}/{name(shard, 'idx')}") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 3)


def _records(path: str, shard: int, places: np.ndarray) -> Iterator[bytes]:
    files, folder = store(path)
    with files.open_input_file(f"{folder}/{name(shard, 'bin')}") as f:
        for offset, length, _ in places.tolist():
            if f.tell() != offset:
                f.seek(offset)
            yield f.read(length)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[3])
        if n >= BATCH_BYTES:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                      names=["id", "shard", "start", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records: `id`, `shard`, `start` (ids of all documents before), `ids` (unsigned 32-bit, little-endian)."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for shard, before in zip(b.column("shard").to_pylist(), b.column("before").to_pylist(), strict=True):
                    places = entries(path, shard)
                    for record, first in zip(_records(path, shard, places), places[:, 2].tolist(), strict=True):
                        doc_id, ids = parse(record)
                        yield doc_id, shard, before + first, ids.tobytes()

        yield from _batches(rows())

    return _shards(spark, path).mapInArrow(get, FOUND)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of all shards: `shard`, `place`, `offset`, `length`, `start`."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before in zip(b.column("shard").to_pylist(), b.column("before").to_pylist(), strict=True):
                e = entries(path, shard).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(e), shard), "place": np.arange(len(e)), "offset": e[:, 0], "length": e[:, 1], "start": e[:, 2] + before})

    return _shards(spark, path).mapInArrow(get, "shard long, place long, offset long, length long, start long")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """All records in an order drawn by `seed`: only index entries are shuffled, records are fetched by offset."""
    n = tasks or spark.sparkContext.defaultParallelism
    drawn = F.xxhash64(F.lit(seed), "shard", "place")
    dealt = index(spark, path).withColumn("k", drawn).repartitionByRange(n, "k").sortWithinPartitions("k")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)

        def rows():
            open_: dict[int, pa.NativeFile] = {}
            for b in batches:
                for shard, offset, length, start in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "start")), strict=True):
                    if shard not in open_:
                        if len(open_) >= 64:
                            open_.pop(next(iter(open_))).close()
                        open_[shard] = files.open_input_file(f"{folder}/{name(shard, 'bin')}")
                    doc_id, ids = parse(open_[shard].read_at(length, offset))
                    yield doc_id, shard, start, ids.tobytes()

        yield from _batches(rows())

    return dealt.mapInArrow(get, FOUND)


def op1_token_records(spark, sf_dir):
    """`documents` as token records, written and read back."""
    import public_tokenizers as P

    path = scratch(spark, "records")
    write(documents(spark, sf_dir), path, P.path("byte_bpe_50k.json"), special=True)
    return read(spark, path).select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_records": op1_token_records}
ORACLE: dict[str, str] = {}
