"""Tables kept for many look-ups: text postings, a log by day, requests by day, sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import knowledge as kn
from faultline.operators import payload as pl
from faultline.operators import postings
from faultline.operators import requests as rq
from faultline.sources import logs as lg


def _texts(rng, n, letters="abc "):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_containing_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = _texts(rng, 120) + ["aaaa", "aaa", "x", "", "aaaa"]
    needles = _texts(rng, 80)[:60] + ["a", "ab", "aaa", "zzz", "abz", "", "b a", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(x,) for x in needles], "needle string")
    want = {(x, i) for x in needles if x for i, t in enumerate(texts) if x in t}
    for index in (None, postings.postings(rows)):
        got = [tuple(r) for r in postings.containing(asked, rows, index).select("needle", "id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_fuzzy_match_equals_nested_loop(spark):
    rng = random.Random(5)
    users = [(f"u{n}", n, f"m{n}@x", *(x or None for x in _texts(rng, 2, "abé"))) for n in range(60)]
    people = [(x,) for x in _texts(rng, 60, "abé") + ["", "A", "BA", "m3@x", "m99@x", "nobody"]] + [(None,)]
    got = pl.match_user_fuzzy(spark.createDataFrame(people, "person string"), spark.createDataFrame(users, "id string, pos int, email string, real_name string, name string"))
    for r in got.collect():
        p = r.person
        want = next((u[0] for u in users if p and "@" in p and u[2] == p), None)
        if want is None and p:
            want = next((u[0] for u in users if p.lower() in (u[3] or "").lower() or p.lower() in (u[4] or "").lower()), None)
        assert r.user_id == want, p


def test_text_index_equals_contains(spark, tmp_path):
    rng = random.Random(7)
    texts = _texts(rng, 200, "abC ") + [None, "", "Long needle here"]
    fixes = spark.createDataFrame([(f"f{n}", t, n) for n, t in enumerate(texts)], "id string, error_text string, other int")
    index = kn.error_text_index(fixes, str(tmp_path / "index"))
    for needle in ("", "a", "Ab", "abc", "c a", "bcab", "NEEDLE", "zzz", "needle z"):
        got = {(r.id, r.error_text, r.other) for r in kn.search_fixes_by_error(index, needle).collect()}
        assert got == {tuple(r) for r in kn.search_fixes_by_error(fixes, needle).collect()}, needle


def test_look_up_by_id_passes_over_row_groups(spark, tmp_path):
    at, rows = dt.datetime(2024, 1, 1), []
    for n in range(60_000):
        rows.append(("app", n, at + dt.timedelta(seconds=3 * n), "INFO", "src.a", f"{random.Random(n // 6).getrandbits(48):012x}", f"m{n}", None))
    schema = "file string, record_line long, ts timestamp_ntz, level string, logger string, request_id string, message string, ctx map<string, string>"
    records = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "log")
    lg.store_app_log(records, path, 2_000, 1 << 16)
    wanted = rows[30_001][5]

    def read(df):
        """Rows found, and rows the scan gave out before the filter."""
        found = df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numOutputRows").value()

    found, seen = read(lg.search_stored_log(spark, path, request_id=wanted))
    assert {r.record_line for r in found} == {n for n in range(60_000) if rows[n][5] == wanted} and seen < 30_000
    assert read(lg.search_stored_log(spark, path, request_id="absent"))[1] < 6_000
    day = lg.search_stored_log(spark, path, "2024-01-02 00:00:00", "2024-01-02 00:10:00")
    assert "day" not in day.columns and day.count() == 201
    assert read(lg.search_stored_log(spark, path, "2024-01-02 00:00:00", "2024-01-02 23:59:59"))[1] <= 28_800


def test_expired_days_go_and_later_files_stay(spark, tmp_path):
    at, path = dt.datetime(2024, 1, 10, 12), str(tmp_path / "requests")
    rows = [(n, at - dt.timedelta(hours=6 * n)) for n in range(40)] + [(99, None)]
    rq.store_requests(spark.createDataFrame(rows, "id int, timestamp timestamp_ntz"), path)
    folder = tmp_path / "requests"

    def files():
        return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}

    before = files()
    assert tuple(rq.expire_stored(spark, path, "2024-01-10 12:00:00", 5).first()) == (19, 22)
    left = spark.read.parquet(path)
    assert {r.id for r in left.collect()} == {*range(21), 99}
    after = files()
    edge = {f for f in before | after if "day=2024-01-05" in f}
    assert after - edge == {f for f in before - edge if f >= "day=2024-01-06"}
    assert {f for f in after & edge} != {f for f in before & edge} and not [d for d in folder.iterdir() if d.is_dir() and d.name < "day=2024-01-05"]
    assert tuple(rq.expire_stored(spark, path, "2024-01-10 12:00:00", 5).first()) == (0, 22) and files() == after
    # The limit at midnight: the boundary day stays whole; one at its end goes whole.
    assert tuple(rq.expire_stored(spark, path, "2024-01-11 00:00:00", 5).first()) == (2, 20)
    assert tuple(rq.expire_stored(spark, path, "2024-01-11 23:00:00", 1).first())[1] == spark.read.parquet(path).count()


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_merged_sketches_stay_close(spark, kind):
    rng = random.Random(9)
    at = dt.datetime(2024, 1, 10, 12)
    times = [rng.expovariate(1) if kind == "spread" else float(rng.randint(1, 5)) for _ in range(20_000)]
    rows = [(n, at - dt.timedelta(seconds=rng.randrange(80_000)), t) for n, t in enumerate(times)] + [(0, at, None), (1, at - dt.timedelta(days=9), 1e9)]
    requests = spark.createDataFrame(rows, "id int, timestamp timestamp_ntz, processing_time double")
    got = rq.sketched_percentiles(rq.latency_sketches(requests), "2024-01-10 12:30:00", 24).first()
    assert got.requests == 20_000 and abs(got.avg_time - sum(times) / 20_000) < 1e-9
    for name, q in (("median_time", 0.5), ("p95_time", 0.95), ("p99_time", 0.99)):
        assert sum(t < got[name] for t in times) / 20_000 <= q + 0.01 and sum(t <= got[name] for t in times) / 20_000 >= q - 0.01
    assert rq.sketched_percentiles(rq.latency_sketches(requests.filter(F.lit(False))), "2024-01-10 12:30:00").count() == 0
