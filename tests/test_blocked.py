import random

from pyspark.sql import functions as F

from faultline.operators import blocked


def rows(spark, n=500, seed=3):
    r = random.Random(seed)
    data, pos = [], {"hot": 0, "b": 0}
    for _ in range(n):
        key = "hot" if r.random() < 0.8 else "b"
        data.append((key, pos[key], r.choice([None, None, 1, 2, 3])))
        pos[key] += 1
    return data, spark.createDataFrame(data, "k string, pos bigint, v int")


def test_carry_forward_matches_plain_scan(spark):
    data, df = rows(spark)
    small = blocked.block_of(F.col("pos"), 7)
    for inclusive in (True, False):
        out = blocked.carry_forward(df, ["k"], "pos", {"last_v": F.col("v")}, {"total": F.col("v")}, block=small, inclusive=inclusive)
        got = {(r.k, r.pos): (r.last_v, r.total) for r in out.collect()}
        last, total = {}, {}
        for k, pos, v in data:
            before = (last.get(k), total.get(k, 0))
            if v is not None:
                last[k], total[k] = v, total.get(k, 0) + v
            assert got[k, pos] == ((last.get(k), total.get(k, 0)) if inclusive else before)


def test_number_rows_is_gapless(spark):
    data, df = rows(spark)
    out = blocked.number_rows(df.drop("v"), ["k"], ["pos"], blocked.block_of(F.col("pos"), 11), "n")
    assert all(r.n == r.pos for r in out.collect())


def test_last_rows_of_a_long_key(spark, monkeypatch):
    data, df = rows(spark)
    monkeypatch.setattr(blocked.block_of, "__defaults__", (16,))
    for count in (1, 40, 10_000):
        got = sorted((r.k, r.pos) for r in blocked.last_rows(df, ["k"], "pos", count).collect())
        want = sorted(x for k in ("hot", "b") for x in sorted((a, p) for a, p, _ in data if a == k)[-count:])
        assert got == want

def test_spans_to_blocks(spark):
    spans = spark.createDataFrame([(5, 25), (7, 6)], "s bigint, e bigint")
    assert sorted(r._blk for r in blocked.spans_to_blocks(spans, "s", "e", 10).collect()) == [0, 1, 2]
