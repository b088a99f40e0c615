"""Retained impact and clipping: counted small groups in plain windows give the rows of the chunked form."""

from lobloom.operators.crosssection import winsorise
from lobloom.plans import retained as R
from lobloom.sources.derived import lob


def test_small_sessions_give_the_rows_of_chunks(spark, monkeypatch):
    events = lob(spark, "/root/testdata/sf0.001", 500)

    def run():
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in R.retained_impact(events).collect()), key=repr)

    small = run()
    monkeypatch.setattr(R, "span_of", lambda *_: R.SPAN)
    assert run() == small and small


def test_clipping_by_plain_windows(spark):
    df = spark.createDataFrame([(i % 3, float(i * 7 % 50), None if i % 5 == 0 else float(i % 4)) for i in range(120)], "g int, a double, b double")
    got = [sorted(winsorise(df, ["g"], {"x": "a", "y": "b"}, 0.1, 0.9, "n", 5, whole).select("g", "a", "b", "x", "y", "n").collect(), key=repr) for whole in (True, False)]
    assert got[0] == got[1] and any(r.a != r.x for r in got[0])


def test_clipping_of_small_groups_takes_no_value_ranges(spark):
    df = spark.createDataFrame([(1, 2.0)], "g int, a double")
    plans = [winsorise(df, ["g"], {"x": "a"}, whole=w)._jdf.queryExecution().executedPlan().toString() for w in (True, False)]
    assert "xxhash64" not in plans[0] and "xxhash64" in plans[1]
