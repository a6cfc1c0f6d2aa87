"""Date patterns are looked for only in texts that can match them, and nothing is lost by that."""

import random
import re

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.operators import timeline as tl

PARTS = ["1", "12", "2020", "99", "123", "/", "-", " ", "\n", ", ", ",", "May", "march ", "x", "_", ".", "20201"]
KNOWN = ["1/2/2020", "a 01-02-1999.", "2020-1-2", "May 3, 2020", "3 May 2020 and 4/5/21", "May  3\n2020", "", "1/2/20201", "x1/2/2020", "_12/31/99", None]


def test_hints_lose_no_mention(spark):
    rng = random.Random(3)
    texts = KNOWN + ["".join(rng.choices(PARTS, k=rng.randrange(3, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").select(
        "doc_id", F.explode(tl.mentions_in(F.col("content"))).alias("m")).select("doc_id", "m.position", "m.raw_date", "m.format").collect()
    want = [(k, m.start(), m.group(), fmt) for k, text in enumerate(texts) for fmt, pattern, _ in lx.DATE_PATTERNS
            for m in re.finditer(pattern, text or "", re.ASCII)]
    assert sorted(map(tuple, got)) == sorted(want) and len({w[3] for w in want}) == len(lx.DATE_PATTERNS)


def test_patterns_stand_behind_their_hints(spark):
    plan = spark.range(1).select(tl.mentions_in(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert set(lx.DATE_HINTS) == {fmt for fmt, _, _ in lx.DATE_PATTERNS}
    assert all(hint in plan for _, hint in lx.DATE_HINTS.values())
