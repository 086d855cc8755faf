import random

from lodestat.plans.ordering import with_position
from lodestat.plans.series import index_series


def drawn(n):
    draw = random.Random(n)
    group = lambda: draw.choice([None, "a", "hot", "hot", "hot"])
    return [(group(), i, draw.randrange(4), draw.randrange(3)) for i in draw.sample(range(10 * n), n)]


def test_positions_and_totals_against_a_sort(spark):
    for n, parts in ((500, 9), (3, 2), (0, 1)):
        rows = drawn(n)
        df = spark.createDataFrame(rows, "g string, i long, w long, v int").repartition(parts)
        got = {(r["g"], r["i"]): r for r in with_position(df, ["g"], ["i"], weight="w", also="v").collect()}
        assert len(got) == n
        for g in {r[0] for r in rows}:
            w = v = 0
            mine = sorted(r for r in rows if r[0] == g)
            for k, (_, i, a, b) in enumerate(mine):
                r = got[g, i]
                assert (r["__pos"], r["__size"], r["__before"], r["__before_also"]) == (k, len(mine), w, v)
                w, v = w + a, v + b
                assert r["__total"] == sum(x[2] for x in mine)


def test_no_exchange_after_the_range_sort(spark):
    df = spark.createDataFrame(drawn(400), "g string, i long, w long, v int").repartition(6)
    series = index_series(df, "w", "i", "g")
    plan = series.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert [r["t"] for r in series.df.where("__key0 = 'a'").orderBy("t").collect()] == list(range(series.df.where("__key0 = 'a'").count()))
