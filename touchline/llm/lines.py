"""Fuzzy line dedup by MinHash.

A line's shingles are its runs of five characters.  Its signature is the least hash
of these under each of some random permutations; a band is a few of them, and lines
with an equal band share a bucket.  Similar lines of a bucket end in one component, by
the exact Jaccard similarity of all their shingles; the links go to a distributed
union-find, and of each component the first line in the corpus stays.

Signatures and similarities are worked out on Arrow batches, all lines of a batch at
once; all else is DataFrame functions.  A line that is there many times is signed once a
batch.  Lines are compared only if their sketches allow that they are similar; sketches of all lines of a
bucket meet, and of these pairs only those that pass leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from touchline.llm.common import WORD, Flags, components, documents, inner, let
from touchline.session import cut, forget

#: Characters that a line needs to take part if the caller says nothing; op7 and the pipeline take every line with a word.
LEAST = 40
SHINGLE, SIMILAR = 5, 0.8
#: Bands, and rows of a band: of two lines that are 0.8 alike 98.6 % share a bucket, of 0.85 99.9 %.
BANDS, ROWS = 14, 6
#: So many times each line is compared with one other of a bucket. Of the buckets that are not in one component then, lines of parts of about
#: LISTED lines are compared with the one most like them, and what is still apart with all that can be similar.
FIRSTS, LISTED = 1, 16
#: Words of 64 bits of a line's sketch.
SKETCH = 8
#: Characters of the lines that are signed at once (one line at least), and of those whose shingles a comparing task remembers.
BATCH, REMEMBERED = 1 << 18, 1 << 22
U = np.uint64
_draw = np.random.default_rng(7)
FACTORS = _draw.integers(1 << 31, 1 << 32, BANDS * ROWS).astype(np.uint32) | np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finish of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def runs_of(text: str) -> np.ndarray:
    """64-bit hashes of the runs of SHINGLE characters, in order; one of a shorter text as a whole."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    width = min(SHINGLE, len(chars))
    runs = chars[:len(chars) - width + 1].copy() if width else np.zeros(1, U)
    for k in range(1, width):
        runs = runs * U(0x9E3779B97F4A7C15) + chars[k:len(chars) - width + 1 + k]
    return runs


def band_keys(lines: list[str]) -> np.ndarray:
    """The BANDS bucket keys of some lines of SHINGLE characters at least, a row per line."""
    n = np.array([len(x) for x in lines], np.int64)
    runs = runs_of("".join(lines))
    # The last runs of a line would reach into the next one.
    own = np.ones(len(runs), bool)
    ends = np.cumsum(n)
    for k in range(1, SHINGLE):
        own[ends[:-1] - k] = False
    h = (mixed(runs) >> U(32)).astype(np.uint32)[own]
    first = np.cumsum(n - SHINGLE + 1) - (n - SHINGLE + 1)
    out = np.empty((len(lines), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, U)
        for f in FACTORS[b * ROWS:(b + 1) * ROWS]:
            key = mixed(key + np.minimum.reduceat(h * f, first))
        out[:, b] = key
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def signed(lines: pa.Array) -> pa.Array:
    """The bucket keys of a line; none for null and for one of fewer than SHINGLE characters, which is like nothing but itself."""
    texts = lines.to_pylist()
    at = [k for k, x in enumerate(texts) if x is not None and len(x) >= SHINGLE]
    out: list = [[] for _ in texts]
    if at:
        for k, keys in zip(at, band_keys([texts[k] for k in at]).view(np.int64).tolist(), strict=True):
            out[k] = keys
    return pa.array(out, pa.list_(pa.int64()))


def buckets(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`lk`, `key` of every line that takes part; a line is there once a batch."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, str] = {}
        n = 0
        for b in batches:
            for text in b.column("text"):
                for raw in (text.as_py() or "").encode().split(b"\n"):
                    if len(raw) >= max(least, SHINGLE) and not raw.isspace() and raw not in held:
                        line = raw.decode()
                        if len(line) >= max(least, SHINGLE):
                            held[raw] = line
                            n += len(line)
                            if n >= BATCH:
                                yield rows(held)
                                held, n = {}, 0
        if held:
            yield rows(held)

    def rows(held: dict[bytes, str]) -> pa.RecordBatch:
        lk = np.array([xxhash.xxh64_intdigest(x, 42) for x in held], U).view(np.int64)
        return pa.RecordBatch.from_pydict({"lk": np.repeat(lk, BANDS), "key": band_keys(list(held.values())).view(np.int64).ravel()})

    return docs.select("text").mapInArrow(sign, "lk long, key long")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every line that takes part: `id`, `dk` (hash of its document), `pos`, `lk` (hash of the line), `line`."""
    rows = docs.select("id", F.xxhash64("text").alias("dk"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return rows.where((F.char_length("line") >= least) & F.col("line").rlike(WORD)).withColumn("lk", F.xxhash64("line"))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with `shared` and `all`, how many shingles are in both lines and in either.

    Shingles are told apart by 64 bits of hash.  A task remembers those of the last lines, up to
    REMEMBERED of them and one line at least.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0

        def shingles(lk: int, line: pa.Scalar) -> np.ndarray:
            nonlocal n
            if lk not in held:
                runs = np.sort(runs_of(line.as_py()))
                runs = runs[np.concatenate(([True], runs[1:] != runs[:-1]))]
                if n + len(runs) > REMEMBERED:
                    held.clear()
                    n = 0
                held[lk] = runs
                n += len(runs)
            return held[lk]

        for b in batches:
            shared, either = [], []
            for u, v, x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("a"), b.column("b"), strict=True):
                one, two = shingles(u, x), shingles(v, y)
                both = np.sort(np.concatenate((one, two)))
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
                either.append(len(both) - shared[-1])
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(shared, pa.int32()), pa.array(either, pa.int32())], names=["u", "v", "shared", "all"])

    # As many tasks as a shuffle has, even where the lines are broadcast: comparing is the work.
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u", "v")
    both = pairs.join(texts.withColumnsRenamed({"lk": "v", "line": "b"}), "v").join(texts.withColumnsRenamed({"lk": "u", "line": "a"}), "u")
    return both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long, shared int, all int")


def shingles_of(line: str) -> np.ndarray:
    return np.unique(runs_of(line))


def sketch(runs: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH slots, whether the number of shingles in it is odd.

    A slot that differs between two lines holds a shingle that only one of them has.
    """
    slots = np.bincount((mixed(runs) % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(slots.astype(np.uint8), bitorder="little").view(np.int64)


def sketched(texts: DataFrame) -> DataFrame:
    """`lk`, `r` of the lines with `s`, the number of their shingles, and `bits`, their sketch."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bits = [], []
            for line in b.column("line"):
                runs = shingles_of(line.as_py())
                n.append(len(runs))
                bits.append(sketch(runs))
            yield pa.RecordBatch.from_arrays([b.column("lk"), b.column("r"), pa.array(n, pa.int32()), pa.array(bits, pa.list_(pa.int64()))], names=["lk", "r", "s", "bits"])

    return texts.select("lk", "r", "line").mapInArrow(each, "lk long, r long, s int, bits array<long>")


def possible(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """`u`, `v`, `k`: all pairs of lines of one bucket and different `r` that can be similar, and the part of their shingles that their sketches don't tell apart.

    `texts` has `lk`, `r`, `line`, or `s`, `bits` instead of this; `keys` has `lk`, `keys`.
    Lines of a bucket meet with their sketches alone, and a pair leaves the join only if these tell no more shingles apart than similar
    lines have, in the first bucket of those that both are in.
    """
    both = 2 * SIMILAR / (1 + SIMILAR)
    p = cut((texts if "bits" in texts.columns else sketched(texts)).join(keys, "lk").select("*", F.explode("keys").alias("key")), "line-sketches")
    u, v = (p.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("lk", "r", "s", "bits", "keys")]) for end in "uv")
    shingles = F.col("s_u") + F.col("s_v")
    apart = reduce(add, [F.bit_count(F.get("bits_u", k).bitwiseXOR(F.get("bits_v", k))) for k in range(SKETCH)])
    sizes = F.least("s_u", "s_v") >= SIMILAR * F.greatest("s_u", "s_v") - 1e-6
    once = F.array_min(F.array_intersect("keys_u", "keys_v")) == u["key"]
    pairs = u.join(v, (u["key"] == v["key"]) & (F.col("lk_u") < F.col("lk_v")) & (F.col("r_u") != F.col("r_v")) & sizes & (apart <= (1 - both) * shingles + 1e-6) & once)
    held = cut(pairs.select(F.col("lk_u").alias("u"), F.col("lk_v").alias("v"), (1 - apart / shingles).alias("k")), "line-near")
    forget(p)
    return held


def classes(docs: DataFrame, signatures: DataFrame, least: int = LEAST) -> DataFrame:
    """`node`, `root` of the line hashes that are similar to another; `signatures` has `lk` and `key`, or `keys`.

    Of any two lines of a bucket that are similar, both end in one component.  First each line is compared with one
    other of its buckets, FIRSTS times, each time within those buckets that aren't in one component yet.  Those that are open then are dealt
    into parts of about LISTED lines, and each line is compared with the one of its parts that is most like it by sketch.  In the buckets
    that are open after that all pairs are found whose sketches allow that they are similar (`possible`), and nothing is lost.  Pairs whose
    ends are in one component already can't change anything and are left out.  Without signatures there are no classes.
    """
    w = W.partitionBy("key")
    if "key" not in signatures.columns:
        signatures = signatures.select("lk", F.explode("keys").alias("key"))
    rows = signatures.repartition("key").select("key", "lk", F.min("lk").over(w).alias("a"), F.max("lk").over(w).alias("b"))
    rows = cut(rows.where("a <> b").select("key", "lk").dropDuplicates(), "line-buckets")
    ends = cut(rows.select("lk").distinct(), "line-ends")
    texts = occurrences(docs, least).select("lk", "line").where(Flags(ends, "lk").has("lk")).groupBy("lk").agg(F.first("line").alias("line"))
    texts = cut(texts.join(ends, "lk", "left_semi"), "line-texts")
    roots, done = None, [ends, texts]

    def tried(pairs: DataFrame) -> DataFrame:
        links = cut(compared(pairs, texts).where(F.col("shared") >= SIMILAR * F.col("all")).select("u", "v"), "line-links")
        out = cut(components(links if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)), "line-roots")
        done.append(links)
        return out

    def open_rows() -> DataFrame:
        r = rows.select("key", "lk").join(roots.select(F.col("node").alias("lk"), F.col("root").alias("r")), "lk", "left").withColumn("r", F.coalesce("r", "lk"))
        keys = r.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("key", "n")
        return cut(r.join(keys, "key").select("key", "lk", "n", "r"), "line-buckets")

    def likeliest(found: DataFrame) -> DataFrame:
        best = [found.groupBy(one).agg(F.max_by(other, F.struct("k", other)).alias(other)).select("u", "v") for one, other in (("u", "v"), ("v", "u"))]
        return best[0].union(best[1]).distinct()

    for turn in range(FIRSTS):
        if turn and rows.isEmpty():
            break
        # the other one is the first of a bucket, or the last in every second turn, and of these the one it shares most buckets with
        r = rows if turn else rows.withColumn("r", F.col("lk"))
        one = r.groupBy("key").agg((F.max if turn % 2 else F.min)(F.struct("lk", "r")).alias("o")).select("key", F.col("o.lk").alias("other"), F.col("o.r").alias("ro"))
        pairs = r.join(one, "key").where("r <> ro").groupBy("lk", "other").agg(F.count(F.lit(1)).alias("k"))
        pairs = pairs.groupBy("lk").agg(F.max_by("other", F.struct("k", "other")).alias("other"))
        roots = tried(pairs.select(F.least("lk", "other").alias("u"), F.greatest("lk", "other").alias("v")).distinct())
        done.append(rows)
        rows = open_rows()
    if not rows.isEmpty():
        own = rows.select("lk", "r").distinct()
        bits = cut(sketched(own.join(texts, "lk")).drop("r"), "line-bits")
        parts = rows.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("key", "lk"), F.ceil(F.col("n") / LISTED))))
        keys = lambda df: df.groupBy("lk").agg(F.collect_set("key").alias("keys"))
        some = possible(own.join(bits, "lk"), keys(parts))
        roots = tried(likeliest(some))
        done += [rows, bits, some]
        rows = open_rows()
        found = possible(rows.select("lk", "r").distinct().join(bits, "lk"), keys(rows))
        # the likeliest of each line first: most others are in one component then
        roots = tried(likeliest(found))
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
        roots = tried(found.join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("r_u", "u") != F.coalesce("r_v", "v")).select("u", "v"))
        done.append(found)
    forget(*done, rows)
    return roots


def dropped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`id`, `dk`, `gone`: the numbers of the lines that go, for documents that lose any."""
    roots = classes(docs, buckets(docs, least), least).withColumnsRenamed({"node": "lk"})
    occ = cut(occurrences(docs, least).select("id", "dk", "pos", "lk"), "lines")
    place = F.struct("id", "dk", "pos")
    per_line = cut(occ.groupBy("lk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f")).join(roots, "lk", "left").select(F.coalesce("root", "lk").alias("root"), "lk", "n", "f"), "line-firsts")
    first = cut(per_line.groupBy("root").agg(F.sum("n").alias("n"), F.min("f").alias("f")).where("n > 1").select("root", "f"), "line-classes")
    stays = cut(per_line.join(first.withColumnRenamed("f", "best"), "root").select("lk", "best"), "line-stays")
    gone = occ.where(Flags(stays, "lk").has("lk")).join(stays, "lk").where(~place.eqNullSafe(F.col("best")))
    gone = cut(gone.groupBy("id", "dk").agg(F.collect_set("pos").alias("gone")), "line-drops")
    forget(occ, per_line, first, stays)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "_gone", least: int = LEAST) -> DataFrame:
    """`docs` with the text left to each document and, in `into`, the numbers of its dropped lines.

    Of each component of similar lines the first stays: the one with the smallest
    id (null before all), then by hash of the text and number of the line.  Lines
    of fewer than `least` characters or without a word always stay.  A null text stays
    null; a text that loses all lines becomes empty.  Rows equal in id and text
    share their lot.  Line ends are line feeds.  An empty table stays empty.  A line may be of
    any length.  The caller's columns may have any names but `into`.
    """
    d = inner(docs, id=id_col, text=text_col)
    gone = dropped(d.select("id", F.coalesce("text", F.lit("")).alias("text")), least)
    own = lambda c: F.col("row").getField(c)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hit, dk = Flags(gone, "dk"), F.xxhash64(F.coalesce(own(text_col), F.lit("")))
    clean = rows.where(~hit.has(dk)).select("row", F.lit(None).cast("array<int>").alias("gone"))
    rest = rows.where(hit.has(dk)).withColumn("dk", dk).withColumn("id", own(id_col)).join(gone.withColumnsRenamed({"id": "i", "dk": "d"}), (F.col("dk") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left")
    both = clean.union(rest.select("row", "gone"))
    left = let(lines_of(own(text_col)), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("gone").isNull(), own(text_col)).otherwise(left)
    return both.select(*[(text if c == text_col else own(c)).alias(c) for c in docs.columns], F.coalesce("gone", F.array().cast("array<int>")).alias(into))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """`docs` with the lines that stay; other columns as they are."""
    return dedup(docs, id_col, text_col, "_gone", least).drop("_gone")


def op7_line_dedup(spark, sf_dir):
    """`documents` without lines like an earlier one: what each loses and the digest of what stays."""
    d = dedup(inner(documents(spark, sf_dir), doc_id="doc_id", text="text"), least=1)
    return d.select("doc_id", F.size("_gone").cast("long").alias("n_dropped"), F.array_join(F.sort_array("_gone"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE: dict[str, str] = {}
