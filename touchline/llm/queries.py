"""The registered queries of this package and their checking SQL."""

from __future__ import annotations

from touchline.llm import bpe, exact, lexical, licenses, lines, mixing, passages, private, quality, records, simhash, suffixes, tries

SETS = (records, licenses, quality, bpe, simhash, exact, lines, private, mixing, passages, suffixes, tries, lexical)
QUERIES = {k: q for s in SETS for k, q in s.QUERIES.items()}
ORACLE = {k: q for s in SETS for k, q in s.ORACLE.items()}
