"""First matches without pairs."""

import random

from factmill.functions.text import identity
from factmill.operators import profiles

REQUESTS = "ordinal int, providerId string, npi string, name string, job string"
PROFILES = "key long, providerId string, npi string, providerName string, job string"


def plain_first(profile, requests, scoped):
    """The first request that a profile matches, one by one."""
    _, pid, npi, name, job = profile
    low = lambda s: (s or "").strip().lower()
    for ordinal, rid, rnpi, rname, rjob in sorted(requests):
        rnpi = rnpi or (rid if rid and len(rid) == 10 and rid.isdigit() else None)
        if scoped and job != rjob or low(npi) and low(rnpi) and low(npi) != low(rnpi):
            continue
        if low(pid) and low(pid) == low(rid) or low(npi) and low(npi) == low(rnpi) or low(name) and low(name) == low(rname):
            return ordinal
    return None


def test_first_matches_equal_a_plain_search(spark):
    r = random.Random(3)
    some = lambda *x: r.choice([None, None, "", *x])
    npis = ["1234567890", "2234567890"]
    requests = [(i, some("p1", "P2 ", *npis), some(*npis), some("ann", "Bob"), r.choice("xy")) for i in range(60)]
    found = [(i, some("p1", "p2", *npis), some(*npis), some("Ann", "bob", "c"), r.choice("xy")) for i in range(200)]
    asked, held = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(found, PROFILES)
    for within in (None, ["job"]):
        got = {x["key"]: x["ordinal"] for x in profiles.match_requests(held, asked, "key", within).collect()}
        expected = {p[0]: f for p in found if (f := plain_first(p, requests, within)) is not None}
        assert got == expected


def test_a_name_that_all_share_makes_a_few_rows_a_profile(spark):
    n = 30_000
    asked = spark.range(n).selectExpr("int(id) ordinal", "string(null) providerId", "if(id % 3 = 0, lpad(id, 10, '0'), null) npi", "'Jane Doe' name")
    held = spark.range(n).selectExpr("id key", "string(null) providerId", "if(id % 2 = 0, lpad(id, 10, '0'), null) npi", "'jane doe' providerName")
    got = profiles.match_requests(held, asked, "key").select("key", "ordinal").collect()
    # Without an NPI the very first; with one the first without, or the one of the same NPI if that comes first.
    assert {x["key"]: x["ordinal"] for x in got} == {k: 0 if k % 2 or k == 0 else 1 for k in range(n)}
    from pyspark.sql import functions as F

    index = profiles.first_ordinals(asked.select("ordinal", F.lit("").alias("rid"), identity(F.col("npi")).alias("rnpi"), F.lit("jane doe").alias("rname")), [])
    assert index.count() <= 2 * (n // 3 + 1) + n // 3 + 2
