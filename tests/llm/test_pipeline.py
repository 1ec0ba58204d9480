"""Every stage of the pipeline against what it should make of its own input."""

import base64
import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_dedup import bits, components
from tests.llm.test_rules import counts
from touchline.llm import quality
from touchline.session import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from touchline.llm.common import documents

    docs, at = documents(spark, SF), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        at[name] = [r.asDict() for r in out.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and out.dtypes == documents(spark, SF).dtypes
            docs = out
    raw = {r["doc_id"]: r for r in documents(spark, SF).collect()}
    rules, lines, near, mixed, coded = at.values()

    failed = {i for i, r in raw.items() if (c := counts(r["text"]))[0] < quality.BASE_WORDS or 100 * c[-1] > quality.BASE_REPEATED * c[0]}
    assert rules and not failed & {r["doc_id"] for r in rules} and all(r["text"] == raw[r["doc_id"]]["text"] for r in rules)
    assert len(rules) > 0.8 * (len(raw) - len(failed))

    text = {r["doc_id"]: r["text"] for r in rules}
    assert sorted(r["doc_id"] for r in lines) == sorted(text)
    for r in lines:
        left = iter(text[r["doc_id"]].split("\n"))
        assert not r["text"] or all(x in left for x in r["text"].split("\n"))  # lines go, none is changed or moved
        assert r["n_chars"] == len(r["text"])
    long_lines = Counter(x for r in lines for x in r["text"].split("\n") if len(x) >= 40)
    assert max(long_lines.values()) == 1

    lines.sort(key=lambda r: r["doc_id"])
    f = [bits(r["text"]) for r in lines]
    group = defaultdict(list)
    for r, x in zip(lines, components(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 2), strict=True):
        group[x].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in near) == sorted(map(min, group.values()))

    taken = Counter(r["doc_id"] for r in mixed)
    assert set(taken) <= {r["doc_id"] for r in near} and max(taken.values()) <= 3
    words = {r["doc_id"]: len(r["text"].split()) for r in near}
    assert abs(sum(words[i] * n for i, n in taken.items()) - sum(words.values())) < 0.2 * sum(words.values())

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in coded) == taken
    for r in coded:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
