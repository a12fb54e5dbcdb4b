import random

import pytest

from pulseweave.operators import codes, crosswalk

GEM = "i9 string, i10 string, flag string"


@pytest.fixture()
def gems(spark):
    gem9 = spark.createDataFrame(
        [("001", "A1", "x"), ("001", "A2", "x"), ("002", "A2", "y"), ("003", "B1", "x"), ("004", "C1", "x")], GEM)
    gem10 = spark.createDataFrame(
        [("001", "A1", "z"), ("005", "A1", "z"), ("006", "B1", "z"), ("004", "C1", "x")], GEM)
    return gem9, gem10


def codes_of(spark, *items):
    return spark.createDataFrame([(c,) for c in items], "code string")


def test_directions(spark, rows, gems):
    gem9, gem10 = gems
    c = codes_of(spark, "001", "001", "C1", "zzz")
    assert rows(crosswalk.forward(c, gem9), "code", "target") == [
        ("001", "A1"), ("001", "A2"), ("C1", None), ("zzz", None)]
    assert rows(crosswalk.backward(c, gem10), "code", "target") == [
        ("001", None), ("C1", "004"), ("zzz", None)]
    both = rows(crosswalk.forward_backward(c, gem9, gem10), "code", "target", "flag")
    assert both == [("001", "A1", "x"), ("001", "A2", "x"), ("C1", "004", "x"), ("zzz", None, None)]
    merged = crosswalk.merge_maps(crosswalk.forward(c, gem9), crosswalk.backward(c, gem10))
    assert rows(merged, "code", "target", "flag") == both


def test_secondary_reaches_two_hops_only(spark, rows, gems):
    gem9, gem10 = gems
    # 001 -> A1, A2; A2 is shared by 002 (forward), A1 by 005 (backward); 003 and 004 are not reached
    assert rows(crosswalk.secondary_codes(codes_of(spark, "001"), gem9, gem10)) == [("001",), ("002",), ("005",)]
    assert rows(crosswalk.secondary(codes_of(spark, "001"), gem9, gem10), "code", "target") == [
        ("001", "A1"), ("001", "A2"), ("002", "A2"), ("005", None)]


def test_random_closure(spark):
    rnd = random.Random(2)
    g9 = [(f"{rnd.randint(0, 40):03}", f"A{rnd.randint(0, 40)}", "f") for _ in range(60)]
    g10 = [(f"{rnd.randint(0, 40):03}", f"A{rnd.randint(0, 40)}", "b") for _ in range(60)]
    start = {f"{k:03}" for k in range(4)}

    def both(cs):
        return {c: {(b, f) for a, b, f in g9 if a == c} | {(a, f) for a, b, f in g10 if b == c} for c in cs}

    first = both(start)
    reached = {x for v in first.values() for x, _ in v}
    want = both(start | {a for a, b, _ in g9 + g10 if b in reached})
    got = {}
    for r in crosswalk.secondary(codes_of(spark, *start), spark.createDataFrame(g9, GEM),
                                 spark.createDataFrame(g10, GEM)).collect():
        got.setdefault(r.code, set()).update([(r.target, r.flag)] if r.target else [])
    assert got == want


def test_batch(spark, rows, gems):
    lists = spark.createDataFrame([("a", "001"), ("a", "001"), ("b", "001"), ("b", "zz")], "file string, code string")
    got = crosswalk.convert_batch(lists, "cm", {"cm": gems[0]}, by="file")
    assert rows(got, "file", "icd9", "icd10") == [
        ("a", "001", "A1"), ("a", "001", "A2"), ("b", "001", "A1"), ("b", "001", "A2"), ("b", "zz", None)]
    empty = crosswalk.convert_batch(lists, "other", {"cm": gems[0]}, by="file")
    assert empty.count() == 0 and empty.columns == got.columns


def test_code_rows_equal_plain_joins(spark, rows):
    rnd = random.Random(8)
    diagnoses = spark.createDataFrame(
        [(s, s, rnd.choice(["001", "002", "009", "A1", "Y1", "B7"]), rnd.choice([9, 10])) for s in
         [rnd.choice([1, 1, 1, 2, 3]) for _ in range(80)]],
        "subject_id long, hadm_id long, icd_code string, icd_version int")
    cohort = spark.createDataFrame([(1, 1)] * 3 + [(2, 2)], "subject_id long, hadm_id long")
    gem = spark.createDataFrame(
        [("001", "A1", "x"), ("001", "A1", "y"), ("001", "Y1", "x"), ("002", "B7", "x")], GEM)
    titles = spark.createDataFrame(
        [("A1", 10, "a"), ("A1", 9, "old"), ("B7", 10, "b"), ("B7", 10, "bb"), ("Y1", 10, "y")],
        "icd_code string, icd_version int, long_title string")
    counted = codes.drop_external_causes(
        codes.add_titles(codes.map_to_icd10(codes.match_codes(diagnoses, cohort), gem), titles))
    names = ["subject_id", "hadm_id", "vers_code", "icd_version", "icd10_code", "long_title"]
    for name, df in dict(d=diagnoses, c=cohort, g=gem, t=titles).items():
        df.createOrReplaceTempView(f"plain_{name}")
    plain = spark.sql("""
        SELECT x.subject_id, x.hadm_id, x.code AS vers_code, x.version AS icd_version, x.icd10_code, t.long_title
        FROM (SELECT d.subject_id, d.hadm_id, d.icd_code AS code, d.icd_version AS version,
                     CASE WHEN d.icd_version = 9 THEN g.i10 ELSE d.icd_code END AS icd10_code
              FROM plain_d d JOIN plain_c c USING (subject_id, hadm_id)
              LEFT JOIN plain_g g ON g.i9 = d.icd_code AND d.icd_version = 9) x
        JOIN plain_t t ON t.icd_code = x.icd10_code AND t.icd_version = 10
        WHERE NOT startswith(x.icd10_code, 'Y')""")
    assert rows(codes.repeat_rows(counted), *names) == rows(plain, *names)
    listed = {r.subject_id: (r.codes, sum(r.code_rows)) for r in codes.codes_per_admission(counted).collect()}
    assert listed[1][0] == ["A1", "B7"] and sum(n for _, n in listed.values()) == plain.count()
    attached = codes.attach_codes(
        spark.createDataFrame([(1, 1), (77, 77)], "subject_id long, hadm_id long"),
        codes.codes_per_admission(counted))
    assert {r.subject_id: list(r.codes) for r in attached.collect()} == {1: ["A1", "B7"], 77: []}


def test_repeat_rows_beyond_one_part(spark, monkeypatch):
    monkeypatch.setattr(codes, "_PART", 4)
    df = spark.createDataFrame([("a", 9), ("b", 4), ("c", 1), ("d", 0)], "k string, n_rows long")
    got = {r.k: r["count"] for r in codes.repeat_rows(df).groupBy("k").count().collect()}
    assert got == {"a": 9, "b": 4, "c": 1}


def test_targets_are_made_and_counted_where_the_admission_lies(spark):
    rows = [(s, 10 * s, f"{s % 3:03}", 9 if s % 4 else 10, 2) for s in range(40)]
    matched = spark.createDataFrame(rows, "subject_id long, hadm_id long, icd_code string, icd_version int, n_rows long")
    gem9 = spark.createDataFrame([(f"{k % 2:03}", f"A{k % 50}", "x") for k in range(100)], GEM)
    titles = spark.createDataFrame([(f"A{k}", "t") for k in range(50)] + [("000", "t")], "icd_code string, long_title string")
    merged = matched.groupBy("subject_id", "hadm_id").count().drop("count").hint("merge")
    placed = codes.by_admission(matched.join(merged, codes.ADMISSION))
    assert "REPARTITION_BY_NUM" in placed._jdf.queryExecution().executedPlan().toString()
    mapped = codes.map_to_icd10(codes.by_admission(matched), gem9)
    listed = codes.codes_per_admission(codes.add_titles(mapped, titles))
    got = {r.subject_id: (len(r.codes), sum(r.code_rows)) for r in listed.collect()}
    want = {s: (25, 100) for s in range(40) if s % 4 and s % 3 < 2} | {s: (1, 2) for s in range(0, 40, 12)}
    assert got == want
    # The tables are small, yet no task takes what several admissions' rows are multiplied to.
    assert listed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = listed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_repeats_of_a_table_are_joined_once(spark, rows):
    gem9 = spark.createDataFrame([("001", "A1", "x")] * 5_000 + [("001", None, None)] * 2, GEM)
    c = codes_of(spark, "001", "002")
    made = crosswalk.forward(c, gem9)
    assert made.groupBy("code", "target").count().orderBy("code", "target").collect() == [
        ("001", None, 2), ("001", "A1", 5_000), ("002", None, 1)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.rindex("Aggregate"), plan  # top first
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    merged = crosswalk.merge_maps(made, made)
    assert rows(merged) == [("001", "A1", "x"), ("002", None, None)]
    assert "Join" in merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in merged._jdf.queryExecution().optimizedPlan().toString()  # read from what was written
