"""Text expressions.  Python runs only where Spark has no built-in, in Arrow
batches: Unicode folding, Jaro-Winkler, HTML flattening."""

from __future__ import annotations

import html
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _fold(s: str | None) -> str | None:
    if s is None:
        return None
    if s.isascii():
        return s.lower()
    return unicodedata.normalize("NFKD", s).translate(_marks()).lower()


@cache
def _marks() -> dict[int, None]:
    """Every combining mark, for removal; built once per worker."""
    return {i: None for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))}


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility-decompose, drop combining marks, lower-case."""
    return s.map(_fold)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def folded(c: Column) -> Column:
    """As `fold`; only texts that are not ASCII go through Python."""
    return F.coalesce(F.when(is_ascii(c), F.lower(c)), fold(F.when(~is_ascii(c), c)))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_name(folded: Column) -> Column:
    """From a folded name: punctuation to spaces, white space collapsed."""
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}\s]", " "))


def token_sorted(normalised: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalised, " ")), " ")


def slug(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def _common(a: str, b: str) -> tuple[int, int]:
    """Matching characters within the window, and how many are out of order."""
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach))
        while j != -1 and j <= i + reach and not free[j]:
            j = b.find(ch, j + 1)
        if j != -1 and j <= i + reach:
            free[j] = False
            left.append(ch)
    right = [ch for ch, f in zip(b, free) if not f]
    return len(left), sum(x != y for x, y in zip(left, right))


def similarity(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler: prefix up to 4 characters, weight 0.1."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m, swapped = _common(a, b)
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


#: What is not shown, breaks, paragraph ends, and any other tag; values in quotes may hold `>`.
HIDDEN = r"(?s)<!--.*?-->|<[!?][^>]*+>"
BREAK, PARAGRAPH = r"(?i)<br(?=[\s/>])[^>]*+>", r"(?i)</p\s*+>"
TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

RAW_START, RAW_ENDS = r"(?i)^<(?:script|style)\b", r"(?i)^<[^>]*+>|</(?:script|style)\s*+>$"
RAW_SPLIT = r"(?i)(?=<(?:script|style)\b)|(?<=</script>)|(?<=</style>)"


@F.pandas_udf(StringType())
def _entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def plain_text(markup: Column | str) -> Column:
    """HTML as readable text: breaks and paragraph ends become line ends, other tags go, then
    entities are decoded (twice, as feeds often escape twice); null is the empty text."""
    s = F.coalesce(F.col(markup) if isinstance(markup, str) else markup, F.lit(""))

    def shown(part: Column) -> Column:
        for pattern, instead in ((HIDDEN, ""), (BREAK, "\n"), (PARAGRAPH, "\n\n"), (TAG, "")):
            part = F.regexp_replace(part, pattern, instead)
        return part

    # Between the tags of a script or a style sheet nothing is a tag, and entities are decoded once.
    raw = lambda part: F.replace(F.regexp_replace(part, RAW_ENDS, ""), F.lit("&"), F.lit("&amp;"))
    s = F.array_join(F.transform(F.split(s, RAW_SPLIT), lambda part: F.when(part.rlike(RAW_START), raw(part)).otherwise(shown(part))), "")
    s = F.regexp_replace(_entities(_entities(s)), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def epoch_seconds(iso: Column) -> Column:
    """ISO 8601 with Z or an offset to Unix seconds; 0 where unreadable."""
    ts = F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")))
    return F.coalesce(F.unix_micros(ts) / 1e6, F.lit(0.0))


#: Fixed value: a hashtag is a letter and 2 to 30 word characters.
HASHTAG = r"(?U)#([A-Za-z][\w]{2,30})"


def hashtags(text: Column) -> Column:
    """Distinct lower-case hashtags of a post."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1)), lambda t: F.lower(t)))


#: Fixed values of the repeat check.
LINK, WORDS = r"(?U)https?://\S+", 160


def fingerprint(network: Column, handle: Column, text: Column) -> Column:
    """Same author and same words, links aside, give the same value."""
    words = F.substring(collapse(F.lower(F.regexp_replace(text, LINK, ""))), 1, WORDS)
    return F.sha1(F.concat_ws("|", network, handle, words))
