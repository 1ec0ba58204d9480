"""Cutting a text where the byte-pair pattern always cuts, so that pieces can be remembered.

In front of a space that stands alone between two other characters every match of
the pattern ends: no alternative goes from a non-blank on to a blank, and one
blank at most begins a match.  So the encoding of a text is that of its chunks,
one after the other.
"""

from __future__ import annotations

import re
import sys

#: Blanks other than space and line feed, of any script.
ODD = tuple(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
ALONE = re.compile(r"(?<=\S)(?= \S)")
#: Entries of a memory of pieces; some 200 bytes each.
MOST = 800_000


def chunks(text: str) -> tuple[list[str], list[str]]:
    """Chunks as they are, and the words of the chunks that follow: a space and the word each."""
    if not text:
        return [], []
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in ODD):
        return ALONE.split(text), []
    first, *rest = text.split(" ")
    return [first], rest


class Remembered:
    """Encodes texts by chunks that it has met; `fresh` encodes new chunks, to bytes each.

    The memory is bounded: it starts anew when it is full.
    """

    def __init__(self, fresh, most: int = MOST):
        self.fresh, self.most = fresh, most
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by what follows the space

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [chunks(t) for t in texts]
        if len(self.plain) + len(self.spaced) > self.most:
            self.plain.clear()
            self.spaced.clear()
        for known, at, lead in ((self.plain, 0, ""), (self.spaced, 1, " ")):
            new = set().union(*[c[at] for c in cut]).difference(known)
            # Letters and a mark after them are never one match either.
            marked = [w for w in new if w[-1] in ",." and w[:-1].isalpha()]
            new = list(new.difference(marked).union({w[:-1] for w in marked}.difference(known)))
            known.update(zip(new, self.fresh([lead + w for w in new]), strict=True))
            ends = dict(zip(",.", self.fresh([",", "."]), strict=True)) if marked else {}
            known.update({w: known[w[:-1]] + ends[w[-1]] for w in marked})
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        return [b"".join([*map(plain, a), *map(spaced, b)]) for a, b in cut]

    def get(self, chunk: str) -> bytes | None:
        return self.spaced.get(chunk[1:]) if chunk[0] == " " else self.plain.get(chunk)

    def put(self, chunk: str, ids: bytes) -> None:
        if chunk[0] == " ":
            self.spaced[chunk[1:]] = ids
        else:
            self.plain[chunk] = ids


def slices(column, most_chars: int = 1 << 21):
    """Lists of texts of a bounded length together (one text at least); null is the empty text."""
    held, n = [], 0
    for x in column:
        t = x.as_py() or ""
        if held and n + len(t) > most_chars:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held
