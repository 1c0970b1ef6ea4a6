import random

from cohortspark.operators.dates import asof_nearest


def brute(ents, dates):
    out = {}
    for g, eid, p in ents:
        cands = [(dp, di) for dg, di, dp in dates if dg == g]
        back = [c for c in cands if c[0] <= p]
        fwd = [c for c in cands if c[0] >= p]
        b = max(back) if back else None            # last position, largest id
        f = min(fwd) if fwd else None              # first position, smallest id
        if b is None and f is None:
            out[eid] = None
        elif f is None or (b is not None and p - b[0] <= f[0] - p):
            out[eid] = b[1]
        else:
            out[eid] = f[1]
    return out


def run(spark, ents, dates, bw=None):
    e = spark.createDataFrame(ents, "group_id long, ent_id long, start long")
    d = spark.createDataFrame([(g, i, p, p * 10) for g, i, p in dates], "group_id long, date_id long, start long, date long")
    res = asof_nearest(e, d, ["group_id"], "start", "date_id", ("date",), bucket_width=bw).collect()
    assert len(res) == len(ents)
    return {r.ent_id: r.date_id for r in res}


def test_edges(spark):
    ents = [(1, 100, 10), (1, 101, 20), (2, 102, 5), (3, 103, 7)]
    dates = [(1, 1, 8), (1, 2, 12),                 # tie of distance for ent 100 -> earlier (1)
             (1, 3, 20), (1, 4, 20),                # two dates at ent 101's position -> last (4)
             (3, 5, 100)]                            # group 2 has no date
    assert run(spark, ents, dates) == {100: 1, 101: 4, 102: None, 103: 5}


def test_random_buckets(spark):
    rng = random.Random(5)
    ents = [(rng.randint(0, 5), i, rng.randint(0, 1000)) for i in range(300)]
    dates = [(rng.randint(0, 5), 1000 + i, rng.randint(0, 1000)) for i in range(200)]
    want = brute(ents, dates)
    for bw in (None, 7, 50, 100000):
        assert run(spark, ents, dates, bw) == want
