import random

from pyspark.sql import functions as F

from pulseweave import plans
from pulseweave.operators import chunks
from pulseweave.operators.membership import may_be_in
from pulseweave.sources import sinks
from test_chunks import COHORT, INPUTS, t


def test_members_pass_and_most_others_do_not(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(20_000), rnd.choice([None, 1, 2]), "x", 7) for _ in range(8000)]
    df = spark.createDataFrame(rows, "a long, b int, _slot string, _place int")
    members = spark.createDataFrame([(k, 1) for k in range(0, 20_000, 50)] + [(None, 1), (5, None)], "a int, b long")
    wanted = {(k, 1) for k in range(0, 20_000, 50)}
    for size in (1, 64, 1 << 16):
        got = may_be_in(df, members, ["a", "b"], size)
        assert got.columns == df.columns
        passed = [(r.a, r.b) for r in got.collect()]
        assert sorted(p for p in passed if p in wanted) == sorted((a, b) for a, b, *_ in rows if (a, b) in wanted)
        assert all(b is not None for _, b in passed)
    assert len(passed) < 1.2 * sum((a, b) in wanted for a, b, *_ in rows) + 5
    assert may_be_in(df, members.where("false"), ["a", "b"]).count() == 0


def exchanged(df):
    """Rows that each exchange of a run has written, by the text of its keys."""
    df.write.format("noop").mode("overwrite").save()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange":
            written = node.metrics().get("shuffleRecordsWritten")
            out.append((node.simpleStringWithNodeId(), written.get().value() if written.isDefined() else 0))
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return out


def test_labs_of_other_admissions_are_not_shuffled(spark, tmp_path):
    """With a cohort that isn't broadcast, little more than its own events goes into the join's exchange."""
    own = [(k, 1, k, 1, t(30), 140.0, "u", None) for k in range(20)]
    other = [(1000 + k, 2, 500 + k % 300, 1, t(30), 140.0, "u", None) for k in range(5000)]
    labs = spark.createDataFrame(own + other, "labevent_id long, subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, "
                                 "valuenum double, valueuom string, flag string")
    items = spark.createDataFrame([(1, "Sodium")], "itemid long, label string")
    cohort = spark.createDataFrame([(1, k, 10 + k, 70 + k, t(0), t(100), 50.0) for k in range(20)], COHORT)
    for name, df in (("labs", labs), ("items", items), ("cohort", cohort)):
        df.write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plans.cohort_labs({"labevents": read("labs"), "d_labitems": read("items")}, read("cohort"))
        assert found.count() == 20
        sizes = [n for _, n in exchanged(found)]
        assert 20 <= max(sizes) <= 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_features_from_indexed_events_move_no_event(spark, tmp_path):
    """Events bucketed by stay are read, joined and thinned out where they lie."""
    cohort = spark.createDataFrame([(1, 1, s, s, t(0), t(600), 50.0) for s in range(8)], COHORT)
    rnd = random.Random(3)
    events = [(rnd.randrange(10), "Levophed", t(a), t(a + 70), 1.0, "mcg/kg/min", None, "Continuous Med")
              for a in (rnd.randrange(900) for _ in range(300))]
    inputs = spark.createDataFrame(events, INPUTS)
    sinks.save_indexed(inputs, "indexed_inputs", ["stay_id"], 4, str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = chunks.chunk_infusions(cohort, spark.table("indexed_inputs"), 60.0)
        text = got._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        scan = next(k for k, line in enumerate(lines) if "indexed_inputs" in line and "Scan" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
        above, level = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < level:
                above.append(line)
                level = depth(line)
        join = next(k for k, line in enumerate(above) if "Join" in line)
        assert not [line for line in above[:join] if "Exchange" in line]
        key = lambda r: tuple(r)
        assert sorted(map(key, got.collect())) == sorted(map(key, chunks.chunk_infusions(cohort, inputs, 60.0).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE indexed_inputs")


def test_least_hours_of_signals(spark):
    from test_sources import tiny_tables

    tables = tiny_tables(spark)
    tables["wave_meta"] = tables["wave_meta"].withColumns({"II_hrs": F.lit(2.0), "PLETH_hrs": F.lit(1.0), "ABP_hrs": F.lit(0.4)})
    assert plans.build_cohort(tables).count() == 1
    assert plans.build_cohort(tables, least_hours=0.4).count() == 1
    assert plans.build_cohort(tables, least_hours=0.5).count() == 0
