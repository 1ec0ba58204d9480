"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one valid encoding, and that of a longer prefix only
adds to or replaces its end; so it is enough to keep, for each prefix, the last
token of its encoding.  Token t is the last of prefix p exactly if p minus t has
a last token u after which t may stand: merging the bytes of u and t together
must leave the two as they are.  Appending bytes is exact, and after an edit only
the part up to the next agreement is done again.
"""

from __future__ import annotations

import base64
import functools
import math
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.chunks import Remembered, slices
from touchline.llm.common import documents, inner

MOST_PAIRS = 500_000


class Pairs(dict):
    """Whether a token may follow another, as far as it was asked; the number of answers kept is bounded."""

    def __init__(self, v: Vocabulary, most: int = MOST_PAIRS):
        super().__init__()
        self.v, self.most = v, most

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.v.may_follow(key >> 32, key & 0xFFFFFFFF)
        return out


class Vocabulary:
    """Ranks of byte strings, as a file of lines `base64 rank`, and the pattern that cuts texts to pieces."""

    def __init__(self, lines: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.token = dict(zip(self.rank.values(), self.rank.keys(), strict=True))
        self.table = pa.array([self.token.get(t) for t in range(max(self.token) + 1)], pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.size = {t: len(b) for t, b in self.token.items()}
        self.longest = max(self.size.values())
        self.within = ahocorasick.Automaton()
        for b, t in self.rank.items():
            self.within.add_word(b.decode("latin-1"), (len(b), t))
        self.within.make_automaton()
        self.parts = functools.cache(self._parts)
        self.rising, self.leading = functools.cache(lambda t: self._spine(t, 1)), functools.cache(lambda t: self._spine(t, 0))
        self.pairs = Pairs(self)
        if lost := [t for t in self.token if len(self.token[t]) > 1 and self.parts(t) is None]:
            raise ValueError(f"no merge makes the tokens {lost[:5]}")

    def _parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token t; None for a byte and for what no merge reaches."""
        seq, get = [self.rank[bytes([b])] for b in self.token[t]], self.rank.get
        while len(seq) > 2:
            best, at = math.inf, -1
            for i in range(len(seq) - 1):
                r = get(self.token[seq[i]] + self.token[seq[i + 1]])
                if r is not None and r < best and r < t:
                    best, at = r, i
            if at < 0:
                return None
            seq[at:at + 2] = [best]
        return tuple(seq) if len(seq) == 2 else None

    def _spine(self, t: int, side: int) -> list[int]:
        """The tokens that stand at one end of t while it is put together, from the byte up to t."""
        out = [t]
        while (p := self.parts(out[-1])) is not None:
            out.append(p[side])
        return out[::-1]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b leaves a, b.

        The ends that face each other grow in the order of ranks, the left one
        first among equals.  A merge across the border happens if its turn comes
        before either end has grown further.
        """
        left, right, get, token = self.rising(a), self.leading(b), self.rank.get, self.token
        i = j = 0
        while True:
            grow_l = left[i + 1] if i + 1 < len(left) else math.inf
            grow_r = right[j + 1] if j + 1 < len(right) else math.inf
            m = get(token[left[i]] + token[right[j]])
            if m is not None and m < grow_l and m <= grow_r:
                return False
            if grow_l == grow_r == math.inf:
                return True
            if grow_l <= grow_r:
                i += 1
            else:
                j += 1

    def grow(self, data: bytes, last: list[int]) -> list[int]:
        """Append the last tokens of all longer prefixes of `data` to those of the first ones."""
        pairs, at, add = self.pairs, len(last), last.append
        # All tokens that end at a byte, byte by byte; one of them is the last of its prefix.
        for end, (before, t) in self.within.iter(data.decode("latin-1"), max(0, at - self.longest)):
            if end == at and (end < before or pairs[last[end - before] << 32 | t]):
                add(t)
                at += 1
        return last

    def back(self, last: list[int]) -> list[int]:
        """The encoding, read from its end."""
        out, n, size = [], len(last), self.size
        while n:
            t = last[n - 1]
            out.append(t)
            n -= size[t]
        out.reverse()
        return out

    def piece(self, p: str) -> list[int]:
        data = p.encode()
        # A piece that is a token as a whole is never merged step by step.
        return [self.rank[data]] if data in self.rank else self.back(self.grow(data, []))

    def encode(self, text: str) -> list[int]:
        return [t for p in self.pattern.findall(text) for t in self.piece(p)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Editable:
    """A text that stays encoded while it is edited."""

    #: How far beyond its end the pattern may look to decide a match.
    LOOK = 3

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text, self.pieces = vocabulary, "", []  # pieces: (text, last tokens of its prefixes)
        self.edit(0, 0, text)

    def _state(self, p: str, near: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        data = p.encode()
        for q, last in near:  # exact appends: the prefix that an old piece shares is kept
            raw, n = q.encode(), 0
            while n < min(len(raw), len(data)) and raw[n] == data[n]:
                n += 1
            if n:
                return p, self.v.grow(data, last[:n])
        return p, self.v.grow(data, [])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end."""
        text = self.text[:start] + new + self.text[end:]
        keep = at = 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + self.LOOK <= start:
            at += len(self.pieces[keep][0])
            keep += 1
        shift = len(text) - len(self.text)
        # Where old pieces begin behind the edit, moved to the new text
        old, pos = {}, at
        for k in range(keep, len(self.pieces)):
            if pos >= end:
                old[pos + shift] = k
            pos += len(self.pieces[k][0])
        fresh, tail = [], len(self.pieces)
        for m in self.v.pattern.finditer(text, at):
            if m.start() in old:
                tail = old[m.start()]
                break
            fresh.append(self._state(m.group(), self.pieces[keep + len(fresh):keep + len(fresh) + 1]))
        self.text, self.pieces = text, [*self.pieces[:keep], *fresh, *self.pieces[tail:]]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [t for p, last in self.pieces for t in ([self.v.rank[p.encode()]] if p.encode() in self.v.rank else self.v.back(last))]


@functools.lru_cache(maxsize=2)
def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


@functools.lru_cache(maxsize=2)
def remembered(lines: bytes, pattern: str) -> Remembered:
    v = vocabulary(lines, pattern)

    def one(p: str) -> bytes:
        """One piece; it is a chunk too, and is remembered as such."""
        ids = memory.get(p)
        if ids is None:
            ids = array("i", v.piece(p)).tobytes()
            memory.put(p, ids)
        return ids

    def all_of(chunk: str) -> bytes:
        # Letters alone, with or without a space in front, are one match.
        pieces = [chunk] if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha() else split(chunk)
        return b"".join(map(one, pieces)) if len(pieces) > 1 else array("i", v.piece(chunk)).tobytes()

    def fresh(new: list[str]) -> list[bytes]:
        return list(map(all_of, new))

    split, memory = v.pattern.findall, Remembered(fresh)
    return memory


class Codec:
    """Column functions of one vocabulary; its file (of fixed size) goes to the executors as a broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = spark.sparkContext.broadcast(f.read())

        def to_ids(texts: pa.Array) -> pa.Array:
            parts = [p for some in slices(texts) for p in remembered(lines.value, pattern).encode(some)]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            if ends[-1] < 2**31:
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            return pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))

        def to_bytes(ids: pa.Array) -> pa.Array:
            v, ends = vocabulary(lines.value, pattern), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            tokens = v.table.take(ids.flatten())  # one behind the other, as the bytes of a row are
            if tokens.null_count:
                raise KeyError("unknown token id")
            at = np.frombuffer(tokens.buffers()[1], "<i8")[tokens.offset:][:len(tokens) + 1][ends]
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.tobytes()), tokens.buffers()[2]])
            return pc.if_else(ids.is_valid(), held, None).cast(pa.binary())

        self.ids = F.arrow_udf(to_ids, T.ArrayType(T.IntegerType()))
        self.bytes = F.arrow_udf(to_bytes, T.BinaryType())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the token ids of its texts.

    Null and empty texts have no ids (an empty array).  Special tokens are not
    known: their strings are ordinary text.  All rows and columns stay; a column
    named `into` is replaced.  An empty table gives an empty table.
    """
    return docs.withColumn(into, Codec(docs.sparkSession, path, pattern).ids(F.col(f"`{text_col}`")))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """`rows` with the bytes that the ids stand for (null for null); unknown ids raise an error."""
    return rows.withColumn(into, Codec(rows.sparkSession, path, pattern).bytes(F.col(f"`{ids_col}`")))


def digests(rows: DataFrame) -> DataFrame:
    """`n_tokens`, `ids_sha256` and `decoded_sha256` beside `ids` and `decoded`."""
    return rows.select("*", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op4_bpe(spark, sf_dir):
    """`documents` encoded and decoded again."""
    import public_tokenizers as P

    file = P.path("byte_bpe_50k.tiktoken")
    d = inner(documents(spark, sf_dir), doc_id="doc_id", text="text")
    return digests(decode(encode(d, file, P.PATTERN), file, P.PATTERN)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
