import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parapet.operators import admission as A
from parapet.plans.admission import admit

START = datetime(2024, 1, 1)
LOG = "request_id long, ts timestamp, api_key string"


def log(spark, rows):
    return spark.createDataFrame(
        [(i, START + timedelta(seconds=s), k) for i, (s, k) in enumerate(rows)], LOG
    )


def brute(rows, window):
    """Counts by the plain rule: evict, append, count."""
    buckets, out = defaultdict(deque), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    for i in order:
        second, key = rows[i]
        bucket = buckets[key or "anonymous"]
        while bucket and bucket[0] < second - window:
            bucket.popleft()
        bucket.append(second)
        out[i] = (len(bucket), START + timedelta(seconds=bucket[0]))
    return out


def test_counts_equal_the_plain_rule_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 900), rng.choice(["hot", "hot", "a", "b", None])) for _ in range(1500)]
    policy = A.QuotaPolicy(60, 60)
    got = {r.request_id: (r.window_count, r.window_start)
           for r in A.sliding_counts(log(spark, rows), policy).collect()}
    assert got == brute(rows, 60)


def test_limit_burst_and_reset(spark):
    rows = [(i, "k") for i in range(5)]
    plain = A.rate_limit(log(spark, rows), A.QuotaPolicy(3, 60)).orderBy("ts").collect()
    assert [r.allowed for r in plain] == [True] * 3 + [False] * 2
    assert [r.remaining for r in plain] == [2, 1, 0, 0, 0]
    assert plain[3].retry_after == 57.0 and plain[0].retry_after is None
    assert plain[4].reset_at == START + timedelta(seconds=60)
    burst = A.rate_limit(log(spark, rows), A.QuotaPolicy(3, 60, 1)).orderBy("ts").collect()
    assert [r.allowed for r in burst] == [True] * 4 + [False]


def test_closed_window_and_ties(spark):
    rows = [(0, "k"), (60, "k"), (121, "k"), (121, "k")]
    got = A.sliding_counts(log(spark, rows), A.QuotaPolicy(3, 60)).orderBy("request_id").collect()
    assert [r.window_count for r in got] == [1, 2, 1, 2]


def test_peek_costs_nothing(spark):
    requests = log(spark, [(0, "k"), (10, "k"), (20, "k"), (15, "other")])
    probes = spark.createDataFrame(
        [(1, "k", START + timedelta(seconds=15)), (2, "k", START + timedelta(seconds=20)),
         (3, "nobody", START), (4, "k", START + timedelta(seconds=81))],
        "probe_id long, api_key string, ts timestamp",
    )
    got = {r.probe_id: r for r in A.peek(requests, probes, A.QuotaPolicy(3, 60)).collect()}
    assert (got[1].window_count, got[1].allowed, got[1].remaining) == (2, True, 1)
    assert (got[2].window_count, got[2].allowed, got[2].remaining) == (3, False, 0)
    assert (got[3].window_count, got[3].remaining, got[3].reset_at) == (0, 3, START)
    assert (got[4].window_count, got[4].allowed) == (0, True)


def test_headers(spark):
    policy = A.QuotaPolicy(1, 1)
    decided = A.rate_limit(log(spark, [(0, "k"), (0.5, "k"), (1.5, "k")]), policy)
    rows = A.quota_headers(decided, policy).orderBy("request_id").collect()
    assert [r.retry_after_s for r in rows] == [None, 0, 1]
    assert rows[0].quota_limit == 1 and rows[0].quota_remaining == 0


def test_admission_order(spark):
    requests = log(spark, [(0, "good"), (1, "bad"), (2, "good"), (3, "good"), (4, "bad"), (5, None)])
    requests = requests.withColumn("status", F.lit(200)).withColumn(
        "path", F.when(F.col("request_id") == 4, "/health").otherwise("/api/v1/query")
    )
    keys = spark.createDataFrame([("good",), ("",)], "api_key string")
    got = {r.request_id: r.admission_status for r in admit(requests, keys, A.QuotaPolicy(2, 60)).collect()}
    assert got == {0: 200, 1: 403, 2: 200, 3: 429, 4: 200, 5: 403}


def test_key_setting(spark):
    df = spark.createDataFrame([(" a, b,,c ",)], "s string")
    assert df.select(A.key_list(F.col("s")).alias("k")).first().k == ["a", "b", "c"]


def test_slices_follow_the_busiest_key(spark):
    from parapet.operators.ordered import fitting_slice, timeline

    rows = [("hot", i * 10_000, 1, i) for i in range(3_000)] + [(f"k{i}", i * 500_000, 1, 5_000 + i) for i in range(60)]
    events = spark.createDataFrame(rows, "key string, at long, kind int, id long")
    day = 86_400_000_000
    assert fitting_slice(events, day) == day
    narrow = fitting_slice(events, day, rows=1_000)
    assert 1_000_000 <= narrow <= 10_000_000
    wide_rows = timeline(events, day).collect()
    assert sorted(wide_rows) == sorted(timeline(events, narrow).collect())
    assert fitting_slice(events.limit(0), day) == day
