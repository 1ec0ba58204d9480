"""Pairs that can't be similar are left out by sketches, and no similar one is."""

import random

from pyspark.sql import functions as F

from tests.llm.test_dedup import prose, similar
from tests.llm.test_lines import edited
from touchline.llm import lines


def test_sketches_keep_all_similar_pairs_of_a_group_and_few_others(spark):
    r = random.Random(41)
    base = [prose(r, 60) for _ in range(8)]
    texts = list(dict.fromkeys(edited(r, x, k) for x in base for k in range(1, 40, 2)))
    rows = [(k, k, k % 2, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "lk long, r long, g long, line string")
    keys = d.select("lk", F.array(F.col("g")).alias("keys"))
    got = {(x["u"], x["v"]) for x in lines.possible(d.drop("g"), keys).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (j - i) % 2 == 0 and similar(texts[i], texts[j])}
    assert want and want <= got and len(got) < 2 * len(want)
    assert all((i - j) % 2 == 0 for i, j in got)
