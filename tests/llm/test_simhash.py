"""Near-duplicates: what a sieve tells apart, and that rows without a duplicate are not moved."""

import random

from tablemill.llm import simhash
from tablemill.llm.shared import sieve, sifted


def test_sieve_holds_every_key_and_few_others(spark):
    rows = spark.range(40_000).selectExpr("if(id % 1000 = 0, null, struct(id, if(id % 2 = 0, null, 'x') as t)) as key", "id")
    keys = rows.where("id % 50 = 0").select("key")
    bits = sieve(keys, "key")
    held, free = sifted(rows, bits, "key", True), sifted(rows, bits, "key", False)
    got = {r["id"] for r in held.collect()}
    assert set(range(0, 40_000, 50)) <= got and len(got) < 2 * 800
    assert {r["id"] for r in free.collect()} == set(range(40_000)) - got
    none = sieve(keys.limit(0), "key")
    assert sifted(rows, none, "key", True).count() == 0 and sifted(rows, none, "key", False).count() == 40_000


def test_rows_that_stay_are_not_moved(spark):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(draw.choices(vocabulary, k=60))) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(40)] + [(None, rows[1][1]), (None, "alone " * 9), (None, None), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        kept = simhash.keep_one(spark.createDataFrame(docs.collect(), docs.schema))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted([(False, *r) for r in rows[:300]] + [(True, 0, "alone " * 9), (True, 0, "")])
    first = plan[plan.index("Union") :].split("\n:- ")[1]
    assert "LeftAnti" in first and "hashpartitioning(_key" not in first
