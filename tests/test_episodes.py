import datetime as dt
import random

from pyspark.sql import functions as F

from cohortspark.operators.episodes import tag_episodes, tag_positive
from cohortspark.params import StudyParams

D = dt.datetime(2020, 1, 1)
DELTA = 15 * 86400


def ts(days, secs=0):
    return D + dt.timedelta(days=days, seconds=secs)


def brute(rows, delta):
    """Connected components of the pair rule; first stay (start, end desc nulls last, id) not recurrent."""
    pos = [r for r in rows if r[4] and r[2] is not None and r[1] is not None]
    parent = {r[0]: r[0] for r in pos}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in pos:
        for b in pos:
            if a[0] != b[0] and a[1] == b[1] and a[3] is not None and a[2] <= b[2] and (b[2] - a[3]).total_seconds() <= delta:
                parent[find(a[0])] = find(b[0])
    comps = {}
    for r in pos:
        comps.setdefault(find(r[0]), []).append(r)
    out = {r[0]: False for r in rows}
    for members in comps.values():
        members.sort(key=lambda r: (r[2], 0 if r[3] is not None else 1, -(r[3].timestamp() if r[3] else 0), r[0]))
        for r in members[1:]:
            out[r[0]] = True
    return out


SCHEMA = "encounter_num long, patient_num long, visit_start_date timestamp_ntz, visit_end_date timestamp_ntz, positive_visit boolean"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    res = tag_episodes(df, StudyParams(**kw)).select("encounter_num", "recurrent_visit").collect()
    return {r[0]: r[1] for r in res}


def test_edge_rows(spark):
    rows = [
        (1, 1, ts(0), ts(2), True),            # first
        (2, 1, ts(17), ts(18), True),          # gap exactly 15 days -> linked
        (3, 1, ts(33, 1), ts(34), True),       # gap 15 days + 1 s -> new episode
        (4, 1, ts(34), None, True),            # open stay, overlaps 3 -> linked
        (5, 1, ts(36), ts(37), True),          # after an open stay; 3 ended at 34 -> linked via 3
        (6, 2, ts(0), None, True),             # two open stays with equal start: not linked
        (7, 2, ts(0), None, True),
        (8, 3, ts(0), ts(5), True),            # equal starts with and without end -> linked
        (9, 3, ts(0), None, True),
        (10, 4, ts(0), ts(1), True),           # chain of three
        (11, 4, ts(10), ts(20), True),
        (12, 4, ts(30), ts(31), True),
        (13, 5, None, ts(1), True),            # null start
        (14, None, ts(0), ts(1), True),        # null patient never chains
        (15, None, ts(1), ts(2), True),
        (16, 6, ts(0), ts(1), True),           # negative stay between two positives is ignored
        (17, 6, ts(10), ts(40), False),
        (18, 6, ts(30), ts(31), True),
    ]
    got = run(spark, rows)
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False, 9: True,
                   10: False, 11: True, 12: True, 13: False, 14: False, 15: False, 16: False, 17: False, 18: False}
    assert got == {k: v for k, v in brute(rows, DELTA).items()}


def test_random_equals_components_and_buckets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        start = ts(rng.randint(0, 200), rng.choice([0, 1, 3600]))
        end = None if rng.random() < 0.15 else start + dt.timedelta(days=rng.randint(0, 20))
        rows.append((i, rng.randint(0, 15), start, end, rng.random() < 0.85))
    want = brute(rows, DELTA)
    for bucket in (1, 86400, 30 * 86400, 10 ** 9):
        assert run(spark, rows, episode_bucket_seconds=bucket) == want


def test_positive_stays_alone_give_the_same_tags(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        a = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 8000))
        rows.append((i, rng.choice([1, 2, 3, None]), None if i % 41 == 0 else a, None if i % 7 == 0 else a + dt.timedelta(hours=rng.randint(0, 300))))
    stays = spark.createDataFrame(rows, "encounter_num long, patient_num long, visit_start_date timestamp_ntz, visit_end_date timestamp_ntz")
    positive = stays.where("encounter_num % 3 = 0").select("encounter_num", (F.col("encounter_num") % 2 == 0).alias("has_history"))
    got = tag_positive(stays, positive)
    whole = stays.join(positive.withColumn("positive_visit", F.lit(True)), "encounter_num", "left").fillna(False)
    want = tag_episodes(whole).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns[-3:] == ["positive_visit", "has_history", "recurrent_visit"]
    assert tag_positive(stays, positive.where("false")).where("positive_visit or recurrent_visit").count() == 0
