"""Clinical features on the regular chunk grid of each recording.

A chunk is a fixed-width window counted from the start of its recording; the grid
belongs to a cohort row, that is to a (recording, stay) pair.  Events never join the
grid: they join the recordings, and the chunk numbers follow by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseweave import vocab
from pulseweave.functions import clinical
from pulseweave.functions.timing import ceil_div, floor_div, micros, micros_of, plus_micros
from pulseweave.operators.overlap import overlap_join, point_join
from pulseweave.session import materialize, shuffle_count

ROW = ["record_id", "stay_id"]
CHUNK = [*ROW, "chunk_id"]
#: Whom a recording belongs to; the dataset's chunk rows carry these as far as the cohort does.
IDENTITY = ["source_version", "subject_id", "hadm_id"]


#: Consecutive chunks of a recording that are placed, and written, together: about 60 MB
#: of samples at 60 s, 125 Hz and four signals.
BLOCK = 512


def block_of(chunk_id) -> Column:
    return F.call_function("div", F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id, F.lit(BLOCK).cast("long"))


def by_block(df: DataFrame) -> DataFrame:
    """Place rows by (recording, block of chunks).

    Grouping by chunk, joining the chunk's samples and writing them then need no other
    shuffle.  The number of partitions is given, so that it is not reduced by the size of
    these narrow rows: what is made of them is a hundred times wider.
    """
    return df.repartition(shuffle_count(df.sparkSession), "record_id", "block")


def chunk_count(seconds: float) -> Column:
    span = micros("end_timestamp") - micros("start_timestamp")
    return ceil_div(span, micros_of(seconds))


def _grid_end(width: int, chunks: Column) -> Column:
    return plus_micros("start_timestamp", chunks * F.lit(width))


def chunk_grid(cohort: DataFrame, seconds: float = vocab.CHUNK_SECONDS) -> DataFrame:
    """record_id, stay_id, chunk_id, chunk_start for every chunk of every cohort row.

    Copies of a cohort row are dropped ahead of the grid, not within it.
    """
    width = micros_of(seconds)
    rows = cohort.select(*ROW, "start_timestamp", chunk_count(seconds).alias("_n")).distinct()
    ids = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    return (
        rows.where(F.col("_n") > 0)
        .withColumn("chunk_id", F.explode(ids))
        .select(*CHUNK, plus_micros("start_timestamp", F.col("chunk_id") * width).alias("chunk_start"))
    )


def _infusion_runs(cohort: DataFrame, inputs: DataFrame, seconds: float) -> DataFrame:
    """record_id, stay_id, drug, block, first, last, ratenorm, bolus: the chunks of a block that infusions overlap.

    ``inputs`` has one row per infusion of a stay; the copies that matching with
    several recordings made are dropped first.  Each infusion then meets the
    recordings of its stay once, and is cut at the borders of blocks.  Infusions of a drug
    over the same chunks merge, so a block has a bounded number of runs.
    """
    width = micros_of(seconds)
    events = (
        inputs.join(F.broadcast(vocab.drug_frame(inputs.sparkSession)), "label")
        .where(F.col("rate").isNotNull() | F.col("amount").isNotNull())
        .select(
            "stay_id", "drug", "starttime", "endtime", "rateuom",
            F.when(
                F.col("ordercategorydescription").isin(*vocab.CONTINUOUS_ROUTES), F.col("rate")
            ).alias("rate"),
            (
                F.col("amount").isNotNull()
                & F.col("ordercategorydescription").isin(*vocab.BOLUS_ROUTES)
            ).cast("int").alias("bolus"),
        )
        .distinct()
    )
    rows = cohort.select(
        *ROW, "start_timestamp", "weight_kg", chunk_count(seconds).alias("_n")
    ).distinct()
    met = overlap_join(
        events,
        rows,
        ["stay_id"],
        (F.col("starttime"), F.col("endtime")),
        (F.col("start_timestamp"), _grid_end(width, F.col("_n"))),
    )
    since = lambda ts: micros(ts) - micros("start_timestamp")
    return (
        met.select(
            *ROW, "drug", "bolus",
            clinical.normalized_rate(
                F.col("rate"), F.col("rateuom"), F.col("weight_kg")
            ).alias("rate"),
            F.greatest(F.lit(0), floor_div(since("starttime"), width)).alias("_lo"),
            F.least(F.col("_n"), ceil_div(since("endtime"), width)).alias("_hi"),
        )
        .where(F.col("_lo") < F.col("_hi"))
        .withColumn("block", F.explode(F.sequence(block_of("_lo"), block_of(F.col("_hi") - 1))))
        .withColumns({
            "first": F.greatest("_lo", F.col("block") * BLOCK),
            "last": F.least("_hi", (F.col("block") + 1) * BLOCK) - 1,
        })
        .groupBy(*ROW, "drug", "block", "first", "last")
        .agg(F.max("rate").alias("ratenorm"), F.max("bolus").alias("bolus"))
    )


def _over_chunks(runs: DataFrame) -> DataFrame:
    """Per (chunk, drug) of runs that are placed by (recording, block): where they lie, they are spread and merged."""
    return (
        runs.withColumn("chunk_id", F.explode(F.sequence("first", "last")))
        .groupBy("record_id", "block", "stay_id", "chunk_id", "drug")
        .agg(F.max("ratenorm").alias("ratenorm"), F.max("bolus").alias("bolus"), F.lit(1).alias("on"))
    )


def chunk_infusions(
    cohort: DataFrame, inputs: DataFrame, seconds: float = vocab.CHUNK_SECONDS
) -> DataFrame:
    """Per (chunk, drug): largest normalised continuous rate, bolus flag, on flag.

    What is shuffled are runs of chunks, by (recording, block); a long infusion becomes a row
    per chunk only after that.
    """
    drugs = _over_chunks(by_block(_infusion_runs(cohort, inputs, seconds)))
    return drugs.select(*CHUNK, "drug", "ratenorm", "bolus", "on")


def chunk_labs(
    cohort: DataFrame, labs: DataFrame, seconds: float = vocab.CHUNK_SECONDS
) -> DataFrame:
    """Per (chunk, feature): the latest charted value; equal times to the larger event id."""
    width = micros_of(seconds)
    values = (
        labs.join(F.broadcast(vocab.lab_frame(labs.sparkSession)), "label")
        .withColumn("valuenum", clinical.not_nan(F.col("valuenum")))
        .where(F.col("valuenum").isNotNull())
        .select("subject_id", "hadm_id", "labevent_id", "feature", "charttime", "valuenum")
        .distinct()
    )
    rows = cohort.select(
        *ROW, "subject_id", "hadm_id", "start_timestamp", chunk_count(seconds).alias("_n")
    ).distinct()
    met = point_join(
        values,
        rows,
        ["subject_id", "hadm_id"],
        F.col("charttime"),
        (F.col("start_timestamp"), _grid_end(width, F.col("_n"))),
    )
    chunk = floor_div(micros("charttime") - micros("start_timestamp"), width)
    latest = F.max(F.struct("charttime", "labevent_id", "valuenum"))
    return (
        met.withColumn("chunk_id", chunk)
        .groupBy(*CHUNK, "feature")
        .agg(latest.alias("_l"))
        .select(*CHUNK, "feature", F.col("_l.valuenum").alias("value"))
    )


def _drug_entries() -> Column:
    """The features that a (chunk, drug) row sets, as feature and value."""
    return F.array_compact(F.array(*[
        F.when(F.col(kind).isNotNull(), F.struct(
            F.concat_ws("_", "drug", F.lit(kind)).alias("feature"), F.col(kind).cast("double").alias("value")))
        for kind in ("ratenorm", "bolus", "on")
    ]))


def feature_struct(value=None, number: str = "DOUBLE", computed: bool = True) -> Column:
    """The 214 features as one struct, from a per-chunk lookup of the event features.

    ``value`` maps a feature to the SQL text of its nullable double; without it there are
    no events.  Flags default to 0 and the dose sum to 0.0, or to NULL where nothing was
    ``computed``; other features stay NULL.  Written as SQL text because hundreds of Column
    calls take longer to build than the query to run.
    """
    value = value or (lambda name: "CAST(NULL AS DOUBLE)")
    flag = lambda name: f"CAST(coalesce({value(name)}, 0) AS INT)"
    any_of = lambda names: f"greatest({', '.join(['0', *map(flag, names)])})"
    on = {c: [f"{d}_on" for d in vocab.DRUGS if vocab.DRUG_CATEGORY[d] == c] for c in vocab.CATEGORIES}
    derived = {f"{c}_on": any_of(on[c]) for c in vocab.CATEGORIES}
    derived["vasoactive_on"] = any_of(on["vasopressor"] + on["vasodilator"])
    derived["norepi_eq"] = " + ".join(
        ["0.0D"]
        + [f"coalesce({value(f'{d}_ratenorm')}, 0.0D) * {f}D" for d, f in vocab.NOREPI_FACTORS.items()]
    ) if computed else "NULL"

    def field(name):
        text = derived.get(name) or (flag(name) if name in vocab.FLAG_FEATURES else value(name))
        return f"'{name}', CAST({text} AS {'INT' if name in vocab.FLAG_FEATURES else number})"

    return F.expr(f"named_struct({', '.join(map(field, vocab.feature_names()))})")


def in_entries(name: str) -> str:
    """The SQL text of a feature's value in the map ``entries``."""
    return f"try_element_at(entries, '{name}')"


def identity(df: DataFrame) -> list[str]:
    return [c for c in IDENTITY if c in df.columns]


def _blocks(cohort: DataFrame, inputs: DataFrame, labs: DataFrame, seconds: float) -> DataFrame:
    """A row per block of each cohort row, with the chunks that have events and their features.

    What is shuffled are runs of infusions, laboratory values and one row per block, by
    (recording, block).  A block has at most :data:`BLOCK` chunks, a chunk at most one entry
    per feature, which bounds what is collected.
    """
    runs = _infusion_runs(cohort, inputs, seconds)
    values = chunk_labs(cohort, labs, seconds).select(
        *ROW, block_of("chunk_id").alias("block"), F.col("chunk_id").alias("first"), F.col("chunk_id").alias("last"),
        "feature", "value",
    )
    own = identity(cohort)
    rows = cohort.select(*ROW, *own, "start_timestamp", chunk_count(seconds).alias("_n")).distinct()
    blocks = rows.where(F.col("_n") > 0).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.col("_n") - 1)))
    )
    of_row = [F.max(c).alias(c) for c in (*own, "start_timestamp", "_n")]
    lab_entry = F.array_compact(F.array(F.when(F.col("feature").isNotNull(), F.struct("feature", "value"))))
    return (
        by_block(
            blocks.unionByName(runs, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
        )
        .withColumn("chunk_id", F.explode_outer(F.sequence("first", "last")))
        .groupBy("record_id", "block", "stay_id", "chunk_id", "drug", "feature")
        .agg(*of_row, *[F.max(c).alias(c) for c in ("ratenorm", "bolus", "value")])
        .withColumn("on", F.when(F.col("drug").isNotNull(), 1))
        .withColumn("entries", F.concat(_drug_entries(), lab_entry))
        .groupBy("record_id", "block", "stay_id", "chunk_id")
        .agg(*of_row, F.map_from_entries(F.flatten(F.collect_list("entries"))).alias("entries"))
        .groupBy("record_id", "block", "stay_id")
        .agg(*of_row, F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("chunk_id", "entries"))).alias("_held"))
    )


def _empty_chunks() -> Column:
    """The chunks of a block that no event names."""
    first = F.col("block") * BLOCK
    chunks = F.sequence(first, F.least(F.col("_n"), first + BLOCK) - 1)
    return F.array_except(chunks, F.transform("_held", lambda h: h["chunk_id"]))


def _chunk_start(width: int) -> Column:
    return plus_micros("start_timestamp", F.col("chunk_id") * width).alias("chunk_start")


def placed_entries(
    cohort: DataFrame,
    inputs: DataFrame,
    labs: DataFrame,
    seconds: float = vocab.CHUNK_SECONDS,
) -> DataFrame:
    """The cohort's :data:`IDENTITY`, record_id, stay_id, chunk_id, block, chunk_start, entries for every
    chunk, placed by (recording, block).

    ``entries`` maps the features that events set to their values, NULL where there is no
    event; :func:`feature_struct` makes the wide row of it.  Chunks without events are
    added after the shuffle.
    """
    own, nothing = identity(cohort), F.lit(None).cast("map<string,double>")
    empty = F.transform(_empty_chunks(), lambda c: F.struct(c.alias("chunk_id"), nothing.alias("entries")))
    return (
        _blocks(cohort, inputs, labs, seconds)
        .select(*own, "record_id", "block", "stay_id", "start_timestamp", F.inline(F.concat("_held", empty)))
        .select(*own, *CHUNK, "block", _chunk_start(micros_of(seconds)), "entries")
    )


def chunk_features(
    cohort: DataFrame,
    inputs: DataFrame,
    labs: DataFrame,
    seconds: float = vocab.CHUNK_SECONDS,
) -> DataFrame:
    """The wide feature row of every chunk: 214 features, defaults where nothing happened.

    The blocks are written once; the chunks with events and the many without are then made
    of them apart, the latter from constants.
    """
    blocks = materialize(_blocks(cohort, inputs, labs, seconds))
    start = _chunk_start(micros_of(seconds))
    common = ["record_id", "stay_id", "start_timestamp"]
    busy = blocks.select(*common, F.inline("_held")).select(*CHUNK, start, feature_struct(in_entries).alias("_w"))
    idle = blocks.select(*common, F.explode(_empty_chunks()).alias("chunk_id")).select(*CHUNK, start, feature_struct().alias("_w"))
    columns = [*CHUNK, "chunk_start", "_w.*"]
    return busy.select(*columns).unionByName(idle.select(*columns))


def chunk_features_long(
    cohort: DataFrame,
    inputs: DataFrame,
    labs: DataFrame,
    seconds: float = vocab.CHUNK_SECONDS,
) -> DataFrame:
    """record_id, stay_id, chunk_id, feature, value where a feature is not its default.

    Derived features come from the per-drug rows by one more aggregation, where these lie; the
    wide row is not built.
    """
    drugs = _over_chunks(by_block(_infusion_runs(cohort, inputs, seconds)))
    named = F.broadcast(vocab.values_frame(drugs.sparkSession, vocab.DRUG_CATEGORY.items(), "drug, category"))
    rate = {
        d: F.max(F.when(F.col("drug") == d, F.col("ratenorm"))) for d in vocab.NOREPI_FACTORS
    }
    on = {c: F.max((F.col("category") == c).cast("int")) for c in vocab.CATEGORIES}
    derived = (
        drugs.join(named, "drug")
        .groupBy("record_id", "block", "stay_id", "chunk_id")
        .agg(
            clinical.norepi_equivalent(rate.__getitem__).alias("norepi_eq"),
            *[on[c].alias(f"{c}_on") for c in vocab.CATEGORIES],
        )
        .withColumn("vasoactive_on", F.greatest("vasopressor_on", "vasodilator_on"))
    )
    names = ["norepi_eq", "vasoactive_on", *[f"{c}_on" for c in vocab.CATEGORIES]]
    sums = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    plain = lambda e: (e["value"] == 0) & e["feature"].isin("norepi_eq", *vocab.FLAG_FEATURES)
    held = lambda entries: F.inline(F.filter(entries, lambda e: ~plain(e)))
    values = chunk_labs(cohort, labs, seconds).select(*CHUNK, "feature", "value")
    return (
        drugs.select(*CHUNK, held(_drug_entries()))
        .unionByName(derived.select(*CHUNK, held(sums)))
        .unionByName(values)
    )
