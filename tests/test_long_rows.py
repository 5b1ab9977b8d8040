"""Rows of very many facts."""

import random
import time

from pyspark.sql import functions as F

from factmill.operators import profiles


def test_facts_of_a_long_row_are_deduplicated_in_order(spark):
    r = random.Random(1)
    facts = [(r.randrange(4), f"k{r.randrange(9000)}", i) for i in range(50_000)]
    small = [facts[:k] for k in (0, 1, 2, 40)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate([facts, *small])], "i int, f array<struct<rank:int,key:string,n:int>>")
    ranked = F.transform("f", lambda v, i: F.struct(v["rank"].alias("rank"), F.collate(v["key"], profiles.COLLATION).alias("order"), i.alias("at"), v["key"].alias("key"), v["n"].alias("x")))
    plan = df.select("i", profiles.dedupe_sorted(ranked).alias("d"))
    plan.where("i > 0").collect()
    began = time.perf_counter()
    got = {x["i"]: x["d"] for x in plan.collect()}
    assert time.perf_counter() - began < 10
    for i, held in enumerate([facts, *small]):
        best = {}
        for at, (rank, key, n) in enumerate(held):
            best[key] = min(best.get(key, (9, 0, 0)), (rank, at, n))
        order = sorted(best, key=lambda k: (best[k][0], k))
        assert got[i] == [best[k][2] for k in order]
