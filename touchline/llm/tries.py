"""Prefix trie of conversations, as distributed burst tries.

A turn is a token of fixed width, so a conversation is a string of tokens and a
prefix of it is a prefix of the string.  Equal conversations are one string with
a number of members.

All strings begin in one container, which is a shard of the trie that is not yet
split up.  A container with too many strings bursts: its strings share the tokens
up to some depth, and these become trie heads, a chain of nodes; the strings go on
to a new container for each next token.  As this follows the shared tokens at once,
a container takes one round per branching, not one per turn.  When no container is
too large, the strings are sorted within theirs and swept once: neighbours in this
order share their longest prefixes, so a stack of open nodes is all that a sweep
needs.  What heads must know of their subtrees is summed over the containers and
heads below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import inner
from touchline.session import cut

#: Strings of a container, at most; more and it bursts.
FULL = 2048
#: Bytes of a token: a hash of role and text, then the length of the text.
HASH, TOKEN = 16, 24
#: Conversations are rebuilt from a family's first one and their own turns.
FAMILY, HEADS = 5, 9
#: Ids that are joined into one piece before the pieces of a string meet.
PIECE = 10_000
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def token(role: Column, text: Column) -> Column:
    """A turn as TOKEN bytes; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    one = F.concat(F.lpad(F.hex(F.octet_length(role).cast("long")), 16, "0"), role, text)  # the length keeps role and text apart
    return F.concat(F.unhex(F.md5(one.cast("binary"))), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def strings(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv`, `s`: each conversation's turns in order as one string of tokens.

    By turn, null first; equal turns by role, then text, so that repeated rows are
    repeated turns in any order of the input.  Rows without a conversation id belong
    to none.  The turns of one conversation are sorted by Spark and read one at a
    time; what is held of it is its string, TOKEN bytes a turn.
    """
    t = inner(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv IS NOT NULL")
    t = t.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), token(F.col("role"), F.col("text")).alias("token"))
    t = t.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select(F.col("conv").cast("long"), "token")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("conv").to_pylist(), b.column("token").to_pylist(), strict=True))
        convs, out, held = [], [], 0
        for conv, group in groupby(rows, key=lambda r: r[0]):
            convs.append(conv)
            out.append(b"".join(r[1] for r in group))
            held += len(out[-1])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(out, pa.binary())], names=["conv", "s"])
                convs, out, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(out, pa.binary())], names=["conv", "s"])

    return t.mapInArrow(joined, "conv long, s binary")


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its family's first one in place of its own.

    `convs` has `conv`, `s`.  h = crc32 of the decimal id modulo HEADS; the first h
    turns are those of conversation conv - conv % FAMILY (all if it has fewer, none
    if there is no such), then come its own after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    own = convs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    first = convs.where(f"conv % {FAMILY} = 0").select(F.col("conv").alias("base"), F.substring("s", 1, F.lit(TOKEN * (HEADS - 1))).alias("f"))
    none = F.lit(b"")
    s = F.concat(F.coalesce(F.substring("f", F.lit(1), F.col("h") * TOKEN), none), F.substring("s", F.col("h") * TOKEN + 1, F.octet_length("s")))
    return own.join(first, "base", "left").select("conv", s.alias("s"))


def ends(convs: DataFrame) -> DataFrame:
    """`key` (md5 of the string), `sha`: SHA-256 of the ids of the equal conversations, ascending, comma-joined.

    The ids are dealt by range of string and id, so that many equal conversations are
    many tasks; each joins up to PIECE ids, and only these pieces meet, in order.
    """
    ids = convs.select(F.md5("s").alias("key"), "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("key").to_pylist(), b.column("conv").to_pylist(), strict=True))
        for key, group in groupby(rows, key=lambda r: r[0]):
            held: list[int] = []
            for _, conv in group:
                held.append(conv)
                if len(held) == PIECE:
                    yield _piece(key, held)
                    held = []
            if held:
                yield _piece(key, held)

    def _piece(key: str, held: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "first": pa.array(held[:1], pa.int64()), "ids": [",".join(map(str, held))]})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True))
        keys, out = [], []
        for key, group in groupby(rows, key=lambda r: r[0]):
            sha, comma = hashlib.sha256(), b""
            for _, ids in group:
                sha.update(comma + ids.encode())
                comma = b","
            keys.append(key)
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "sha"])

    met = ids.mapInArrow(pieces, "key string, first long, ids string").repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return met.mapInArrow(digests, "key string, sha string")


def part(s: Column, start: Column, stop: Column) -> Column:
    """Tokens `start` to `stop` (exclusive, from 0) of a string."""
    return F.substring(s, start * TOKEN + 1, (stop - start) * TOKEN)


def length_of(s: Column) -> Column:
    """The length of the text of the last of some tokens; 0 if there are none."""
    return F.when(F.octet_length(s) == 0, F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.substring(s, F.octet_length(s) - (TOKEN - HASH) + 1, F.lit(TOKEN - HASH))), 16, 10).cast("long"))


def shared(a: Column, b: Column) -> Column:
    """How many tokens two strings have in common at their beginning."""
    n = F.least(F.octet_length(a), F.octet_length(b)) / TOKEN
    equal = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: (k < n) & (part(a, k, k + 1) == part(b, k, k + 1)))
    return (F.array_position(equal, F.lit(False)) - 1).cast("int")


def burst(rows: DataFrame, full: int = FULL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Containers, all small enough, and the trie heads above them.

    `rows` has `s`, `n` (members), `conv` (the smallest), `sha`.  Returns
    `held`: the rows with `box` (their container), `depth` (of its top node) and `up`
    (smallest member of the node above; null at the root);
    `heads`: `head`, `path` (itself and all heads above), `depth` to `last` (depths of its
    chain), `chain` (tokens before the last node's end), `n`, `conv`, `up`, `children`, `sha`;
    `boxes`: `box`, `path` (heads above).
    """
    now = rows.select("*", F.lit("").alias("box"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"))
    boxes = rows.sparkSession.range(1).select(F.lit("").alias("box"), F.array().cast("array<string>").alias("path"))
    done, heads, shut = None, None, None
    add = lambda a, b: b if a is None else a.union(b)
    while True:
        sizes = now.groupBy("box").agg(F.count(F.lit(1)).alias("k"))
        large = sizes.where(F.col("k") > full).select("box")
        low = now.join(large, "box").groupBy("box").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
                                                        F.first("depth").alias("depth"), F.first("up").alias("up"))
        large = cut(low.withColumn("last", shared(F.col("lo"), F.col("hi"))).join(boxes, "box").withColumn("path", F.concat(F.array("box"), "path")), "trie-large")
        large_boxes = large.select("box", F.col("last"), F.col("conv").alias("top"))
        still = now.join(large_boxes, "box", "left")
        calm = still.where("last IS NULL").select(*now.columns)
        if large.isEmpty():
            return add(done, calm), heads, add(shut, boxes)
        shut = add(shut, boxes.join(large.select("box"), "box", "left_anti"))
        done = add(done, cut(calm, "trie-calm"))
        still = still.where("last IS NOT NULL")
        next_box = F.md5(part(F.col("s"), F.lit(0), F.col("last") + 1))
        moved = still.where(F.octet_length("s") > F.col("last") * TOKEN)
        now = cut(moved.select("s", "n", "conv", "sha", next_box.alias("nb"), (F.col("last") + 1).alias("depth"), F.col("top").alias("up"), "box"), "trie-moved")
        born = cut(now.select("box", "nb").distinct(), "trie-boxes")
        boxes = born.join(large.select("box", "path"), "box").select(F.col("nb").alias("box"), "path")
        here = still.where(F.octet_length("s") == F.col("last") * TOKEN).select("box", "sha")  # one at most: strings are distinct
        heads = add(heads, large.join(born.groupBy("box").agg(F.count(F.lit(1)).alias("children")), "box").join(here, "box", "left").select(
            F.col("box").alias("head"), "path", "depth", "last", part(F.col("lo"), F.lit(0), F.col("last")).alias("chain"), "n", "conv", "up", "children", "sha"))
        now = now.select("s", "n", "conv", "sha", F.col("nb").alias("box"), "depth", "up")


class Open:
    """A node of the stack: what is known of it so far, and its children that wait for its smallest member."""

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.conv, self.n, self.leaves, self.saved, self.sha, self.children = None, 0, 0, 0, NOTHING, []

    def take(self, conv: int, n: int) -> None:
        self.conv, self.n = conv if self.conv is None else min(self.conv, conv), self.n + n


SWEPT = "box string, top boolean, " + NODE


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each container, from its strings in order."""
    names = ["box", "depth", "up", "s", "n", "conv", "sha"]
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    out: list[tuple] = []

    def record(v: Open, parent: int | None) -> tuple:
        return v.conv, v.depth, parent, v.n, len(v.children), v.leaves, v.saved, v.sha

    def close(box: str, stack: list[Open]) -> None:
        v = stack.pop()
        v.leaves, v.saved = max(1, v.leaves), v.saved + (v.n - 1) * v.size
        out.extend((box, False, *record(c, v.conv)) for c in v.children)
        v.children = [None] * len(v.children)
        if stack:
            p = stack[-1]
            p.take(v.conv, v.n)
            p.leaves, p.saved = p.leaves + v.leaves, p.saved + v.saved
            p.children.append(v)

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
        cols = [f.split()[0] for f in SWEPT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=cols)

    for box, group in groupby(rows, key=lambda r: r[0]):
        stack, last, top, up = [], b"", None, None
        for _, depth, up, s, n, conv, sha in group:
            if top is None:
                size = int.from_bytes(s[depth * TOKEN - TOKEN + HASH:depth * TOKEN], "big") if depth else 0
                top = Open(depth, size)
                stack.append(top)
                same = depth
            else:
                same = depth
                m = min(len(last), len(s)) // TOKEN
                while same < m and last[same * TOKEN:same * TOKEN + TOKEN] == s[same * TOKEN:same * TOKEN + TOKEN]:
                    same += 1
            while stack[-1].depth > same:
                close(box, stack)
            for d in range(stack[-1].depth + 1, len(s) // TOKEN + 1):
                stack.append(Open(d, int.from_bytes(s[d * TOKEN - TOKEN + HASH:d * TOKEN], "big")))
            stack[-1].take(conv, n)
            stack[-1].sha, last = sha, s
        while stack:
            close(box, stack)
        out.append((box, True, *record(top, up)))
        if len(out) > 5000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def nodes(convs: DataFrame, full: int = FULL) -> DataFrame:
    """All nodes of the prefix trie of some strings of tokens; `convs` has `conv`, `s`.

    Returns per node: conv_id (its smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  An empty table has
    no node, not even a root.  Rows that repeat are members of their own.
    """
    keyed = convs.withColumn("key", F.md5("s"))
    same = keyed.groupBy("key", "s").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    rows = cut(same.join(ends(convs), "key").select("s", "n", "conv", "sha"), "trie-strings")
    held, heads, boxes = burst(rows, full)
    held = held.select("box", F.col("depth").cast("long").alias("depth"), "up", "s", "n", "conv", "sha")
    found = held.repartition("box").sortWithinPartitions("box", "s").mapInArrow(swept, SWEPT)
    names = [f.split()[0] for f in NODE.split(", ")]
    if heads is None:
        return found.select(*names)
    found = cut(found, "trie-nodes")
    heads = cut(heads.withColumn("of", F.transform(F.sequence("depth", "last"), lambda d: length_of(part(F.col("chain"), F.lit(0), d)))), "trie-heads")
    own = F.col("n") - 1
    below = found.where("top").join(boxes, "box").select("path", "n_leaves", F.col("saved_tokens").alias("saved"))
    above = heads.select(F.expr("slice(path, 2, size(path))").alias("path"), F.lit(0).cast("long").alias("n_leaves"), (own * F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a + x)).alias("saved"))
    sums = below.union(above).select(F.explode("path").alias("head"), "n_leaves", "saved").groupBy("head").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chain = heads.join(sums, "head").withColumn("d", F.explode(F.sequence("depth", "last")))
    is_last, is_first = F.col("d") == F.col("last"), F.col("d") == F.col("depth")
    rest = F.aggregate(F.slice("of", F.col("d") - F.col("depth") + 1, F.size("of")), F.lit(0).cast("long"), lambda a, x: a + x)
    chain = chain.select(F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(is_first, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                         F.when(is_last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + own * rest).alias("saved_tokens"),
                         F.when(is_last, F.coalesce("sha", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    return found.select(*names).union(chain.select(*names))


def op12_prefix_trie(spark, sf_dir):
    """The prefix trie of the rebuilt `conversations`."""
    convs = cut(strings(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversations")
    return nodes(rebuilt(convs))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE = {"op12_prefix_trie": f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
    md5(concat(strlen(coalesce(role, '')), ':', role, text)) || ':' || strlen(coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY t) AS s FROM turns GROUP BY c),
h AS (SELECT c, s, CAST(xor(list_reduce(flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {HEADS} AS INTEGER) AS h FROM own),
whole AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % {FAMILY}),
pre AS (SELECT c, d, len(s) AS n, array_to_string(s[1:d], ',') AS p, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], ',') END AS q,
    CASE WHEN d > 0 THEN CAST(split_part(s[d], ':', 2) AS BIGINT) ELSE 0 END AS bytes FROM whole, range(0, 100000) AS r(d) WHERE d <= len(s)),
node AS (SELECT p, d, any_value(q) AS q, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends FROM pre GROUP BY p, d),
kids AS (SELECT q AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
-- each node counts for those its smallest member passes
below AS (SELECT pre.p, pre.d, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved
    FROM full_node v JOIN pre ON pre.c = v.conv_id AND pre.d <= v.d GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved AS saved_tokens, k.ends AS ends_sha256
FROM full_node k JOIN below USING (p, d) LEFT JOIN node u ON u.p = k.q AND u.d = k.d - 1
"""}
