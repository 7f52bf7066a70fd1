"""Tiled correlations, period versions, staging by content, densities, running totals, bitmaps, automata and bucketed blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientscope.functions.predicates import code_and_keyword
from clientscope.ml.evaluate import class_density
from clientscope.operators import bitmaps as bm
from clientscope.operators import keywords as kw
from clientscope.operators import prefix_state as ps
from clientscope.operators.correlation import correlations, kept_greedy, kept_of_groups
from clientscope.operators.rolling import rolling_windows
from clientscope.sources import sinks
from clientscope.sources.blocks import BlockStore, stored_blocks
from clientscope.sources.periods import ConcurrentWrite, PeriodTable


@pytest.mark.parametrize(("tile", "held"), [(128, 1 << 27), (3, 1 << 27), (4, 1)])
def test_tiles_match_pairwise_correlation(spark, tile, held):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 11)) + 1e6
    x[:, 5] = x[:, 2] * 2 + rng.normal(size=120) * 0.1
    x[:, 9] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    rows = {(r.i, r.j): r.r for r in correlations(df, names, 0.1, tile, held).collect()}
    want, total = {}, [0.0] * 11
    for i in range(11):
        for j in range(11):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            r = np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else math.nan
            total[i] += 0 if math.isnan(r) else abs(r)
            if i < j and abs(r) > 0.1:
                want[i, j] = r
    assert {k for k in rows if k[1] >= 0} == set(want) and (2, 5) in want
    assert all(rows[k] == pytest.approx(r, abs=1e-6) for k, r in want.items())
    assert all(rows[i, -1] == pytest.approx(t, abs=1e-5) for i, t in enumerate(total))


def test_column_rules():
    assert kept_greedy(5, [(0, 1), (1, 2), (3, 4)]) == [0, 2, 3]
    assert kept_of_groups(5, [(0, 1), (1, 2)], [1.0, 3.0, 2.0, 1.0, 1.0]) == [1, 3, 4]
    assert kept_of_groups(2, [(0, 1)], [2.0, 2.0]) == [0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "epk long, report_dt string, score double").withColumn("report_dt", F.col("report_dt").cast("date"))


def test_periods_swap_whole(spark, tmp_path):
    table = PeriodTable(spark, f"{tmp_path}/scores")
    with pytest.raises(ValueError):
        table.read()
    first = table.replace(frame(spark, [(1, "2024-01-31", 1.0), (2, "2024-02-29", 1.0), (3, None, 9.0)]))
    before = table.read()
    seen = lambda df: sorted(((r.epk, str(r.report_dt), r.score) for r in df.collect()))
    assert seen(before) == [(1, "2024-01-31", 1.0), (2, "2024-02-29", 1.0), (3, "None", 9.0)]
    broken = frame(spark, [(5, "2024-02-29", 5.0)]).withColumn("score", F.raise_error(F.lit("no score")).cast("double"))
    with pytest.raises(Exception, match="no score"):
        table.replace(broken)
    assert seen(table.read()) == seen(before) and table.versions() == [first]
    second = table.replace(frame(spark, [(4, "2024-02-29", 2.0)]))
    assert seen(table.read()) == [(1, "2024-01-31", 1.0), (3, "None", 9.0), (4, "2024-02-29", 2.0)]
    assert seen(before) == seen(table.read(version=first)) and seen(table.read(["2024-02-29"])) == [(4, "2024-02-29", 2.0)]
    assert table.read(["2030-01-31"]).count() == 0 and table.read().dtypes == before.dtypes
    table.replace(frame(spark, []))
    gone = table.retain(2)
    assert len(gone) == 1 and "2024-02-29" in gone[0] and table.versions() == [second, second + 1]
    assert seen(table.read(version=second)) == seen(table.read())


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (PeriodTable(spark, f"{tmp_path}/t") for _ in range(2))
    a.replace(frame(spark, [(1, "2024-01-31", 1.0)]))
    publish = b._publish

    def late(number, made):
        a.replace(frame(spark, [(2, "2024-01-31", 2.0)]))
        publish(number, made)

    b._publish = late
    with pytest.raises(ConcurrentWrite):
        b.replace(frame(spark, [(3, "2024-01-31", 3.0)]))
    assert [r.epk for r in a.read().collect()] == [2]
    b._publish = publish
    a.fs.createNewFile(a.Path(f"{a.path}/manifests/0000000003.claim"))
    with pytest.raises(ConcurrentWrite):
        b.replace(frame(spark, [(3, "2024-01-31", 3.0)]))
    b.abandon(3)
    assert b.replace(frame(spark, [(3, "2024-01-31", 3.0)])) == 3 and [r.epk for r in a.read().collect()] == [3]


def test_blocks_are_staged_by_content(spark, tmp_path):
    source, folder, built = f"{tmp_path}/in", f"{tmp_path}/out", []
    spark.range(5).write.parquet(source)

    def block(factor):
        def build():
            built.append(factor)
            return spark.read.parquet(source).select((F.col("id") * factor).alias("v"))

        return sorted(r.v for r in sinks.stage(spark, folder, "block", build, factor=factor).collect())

    digest = sinks.fingerprint(spark.read.parquet(source).select((F.col("id") * 2).alias("v")), a=1)
    assert digest == sinks.fingerprint(spark.read.parquet(source).select((F.col("id") * 2).alias("v")), a=1)
    assert digest != sinks.fingerprint(spark.read.parquet(source).select((F.col("id") * 2).alias("v")), a=2)
    assert block(2) == block(2) == [0, 2, 4, 6, 8] and block(3) == [0, 3, 6, 9, 12]
    folders = lambda: sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(folders()) == 2
    spark.range(5, 7).write.mode("append").parquet(source)
    assert block(2) == [0, 2, 4, 6, 8, 10, 12] and len(folders()) == 3
    assert sinks.fingerprint(spark.range(3)) == sinks.fingerprint(spark.range(3)) != sinks.fingerprint(spark.range(4))


def test_density_by_direct_summation(spark):
    rng = random.Random(5)
    rows = [(k % 2, rng.gauss(k % 2, 1), 4.0) for k in range(80)] + [(0, None, 4.0), (1, 50.0, 4.0)]
    made = class_density(spark.createDataFrame(rows, "y int, a double, flat double"), "y", ["a", "flat"], -4.0, 4.0, 33).collect()
    assert len(made) == 2 * 2 * 33 and all(r.density is None for r in made if r.feature == "flat")
    step = 0.25
    for r in (r for r in made if r.feature == "a"):
        values = [a for y, a, _ in rows if y == r.y and a is not None]
        h, total = np.std(values, ddof=1) * len(values) ** -0.2, 0.0
        for v in values:
            if -4 <= v <= 4:
                at = (v + 4) / step
                lo = min(math.floor(at), 31)
                for j, w in ((lo, 1 - at + lo), (lo + 1, at - lo)):
                    total += w * math.exp(-(((r.point - j) * step / h) ** 2) / 2)
        assert r.density == pytest.approx(total / (len(values) * h * math.sqrt(2 * math.pi)), abs=2e-6)


def test_running_totals_equal_direct_windows(spark):
    """Gaps, clients that start late, several rows a month, targets without history, one more month and late rows."""
    rng = random.Random(6)
    months = ["2023-11-30", "2023-12-31", "2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30", "2024-05-31", "2024-06-30"]
    rows = [(k, m, float(rng.randrange(-50, 100))) for k in range(30) for m in months if rng.random() < 0.4 for _ in range(rng.randrange(1, 3))]
    rows += [(99, "2024-06-30", None)]
    history = frame(spark, rows).withColumnRenamed("score", "v")
    target = frame(spark, [(k, m, 0.0) for k in [*range(30), 99, 1000] for m in months[4:]]).drop("score")
    state = ps.build_state(history.where("report_dt < date'2024-06-30'"), ["v"], "2024-05-31")
    june = ps.next_month(state.where("report_dt = date'2024-05-31'"), history.where("report_dt = date'2024-06-30'"), ["v"], "2024-06-30")
    state = state.unionByName(june)

    def same(state, history):
        made = ps.windows(target, state, ["v"], (1, 3, 6))
        want = rolling_windows(target, history, ["v"], (1, 3, 6), unique_history=False)
        assert made.columns == want.columns
        keyed = lambda df: {tuple(r[:2]): [None if x is None else round(x, 6) for x in r[2:]] for r in df.collect()}
        assert keyed(made) == keyed(want)

    same(state, history)
    late = frame(spark, [(3, "2024-02-29", 500.0), (3, "2024-04-30", 1.0), (555, "2024-03-31", 7.0)]).withColumnRenamed("score", "v")
    changed = ps.with_late_rows(state, late, ["v"])
    assert {str(r[0]) for r in changed.select("report_dt").distinct().collect()} == set(months[3:])
    same(state.where("report_dt < date'2024-02-29'").unionByName(changed), history.unionByName(late))


def test_bitmaps_count_exactly(spark):
    rng = random.Random(7)
    rows = [(f"m{rng.randrange(4)}", rng.choice("ab"), rng.choice([None, rng.randrange(-50, 200_000), rng.randrange(40)])) for _ in range(4000)]
    facts = spark.createDataFrame(rows, "month string, flag string, epk long")
    bits = bm.client_bitmaps(facts, ["month", "flag"], "epk")
    count = lambda by, keep: {b: len({r[2] for r in rows if keep(r, b) and r[2] is not None}) for b in by}
    got = {r.month: r.clients for r in bm.clients(bm.merged(bits, ["month"]), ["month"]).collect()}
    assert got == count({r[0] for r in rows}, lambda r, b: r[0] == b)
    assert bm.clients(bm.merged(bits, []), []).first().clients == len({r[2] for r in rows if r[2] is not None})
    old = bits.where("month <> 'm3'")
    added = old.unionByName(bm.client_bitmaps(facts.where("month = 'm3'"), ["month", "flag"], "epk"))
    assert bm.clients(bm.merged(added, ["flag"]), ["flag"]).orderBy("flag").collect() == bm.clients(bm.merged(bits, ["flag"]), ["flag"]).orderBy("flag").collect()
    both = bm.clients(bm.common(bm.merged(bits, ["month", "flag"]), ["month"], "flag"), ["month"])
    sides = {m: [{r[2] for r in rows if r[0] == m and r[1] == f and r[2] is not None} for f in "ab"] for m in {r[0] for r in rows}}
    assert {r.month: r.clients for r in both.collect()} == {m: len(a & b) for m, (a, b) in sides.items()}


def test_automaton_labels_like_the_ladder(spark):
    rng = random.Random(8)
    words = ["shop", "auto", "market", "bar", "barber", "he", "hers", "ÜBER"]
    rules = [{"label": f"l{k}", "codes": ["a", "b"], "words": rng.sample(words, 3)} for k in range(8)]
    rows = [(rng.choice("abc"), "".join(rng.choice([w, w.upper(), "x", " "]) for w in rng.choices(words, k=3))) for _ in range(600)]
    df = spark.createDataFrame([*rows, ("a", None), ("a", "")], "code string, text string")
    bits = kw.label_bits(df, "text", {r["label"]: r["words"] for r in rules})
    made = bits.select("code", "text", kw.code_and_label(F.col("code"), "labels", rules).alias("l"))
    want = df.select("code", "text", code_and_keyword(F.col("code"), F.col("text"), rules).alias("l"))
    assert made.exceptAll(want).count() == want.exceptAll(made).count() == 0 and made.where("l is not null").count() > 50
    assert kw.label_bits(df, "text", {}).where("labels <> 0").count() == 0
    for bad in ({"a": ["x_y"]}, {"a": [""]}, {str(k): ["w"] for k in range(64)}):
        with pytest.raises(ValueError):
            kw.label_bits(df, "text", bad)


def test_blocks_join_without_an_exchange(spark, tmp_path):
    target = frame(spark, [(k, m, 0.0) for k in range(40) for m in ("2024-01-31", "2024-02-29")]).drop("score")
    blocks = {
        "one": lambda t: t.where("epk % 2 = 0").withColumn("a", F.col("epk") * 2),
        "two": lambda t: t.withColumn("b", F.col("epk") + 1).unionByName(t.withColumn("b", F.col("epk") + 1)),
    }
    store = BlockStore(spark, 4, folder=str(tmp_path))
    made = stored_blocks(store, target, blocks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    rows = {(r.epk, str(r.report_dt)): (r.a, r.b) for r in made.collect()}
    assert rows == {(k, m): (2 * k if k % 2 == 0 else None, k + 1) for k in range(40) for m in ("2024-01-31", "2024-02-29")}
    with pytest.raises(Exception, match="different rows for one key"):
        store.put("bad", target.withColumn("c", F.lit(1)).unionByName(target.withColumn("c", F.lit(2))))
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.prefix)]
