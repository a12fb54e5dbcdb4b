"""Chat formatting: conversations rebuilt from event logs and rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table

# The template.  A turn is OPEN role SPLIT text CLOSE.
OPEN, SPLIT, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: A control string, with any number of backslashes after its first character: each
#: backslash more is one level of escaping, so every text has its own escaped form.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
DELTA, EDIT, REGENERATE, START = "delta", "edit", "regenerate", "start"
_DELTA_CHARS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) from events (conv_id, seq, message, kind, role, text).

    ``message`` orders the messages of a conversation; ``seq`` orders its events.

    * ``start`` opens a message and gives its role; ``delta`` appends its text.
    * ``edit`` replaces a message's text so far by its own.
    * ``regenerate`` clears a message's text so far, and drops later messages that had
      been started before it.

    A message's text is what follows its last edit or regeneration, in order of ``seq``.
    Its role is that of its first event that names one.  Events equal in ``seq`` are
    ordered by kind, then text, so a delta comes before an edit of the same ``seq`` and is lost.  A NULL text is empty, a NULL role empty, an unknown or
    NULL kind counts for the message's existence alone.  A message without a start
    counts as started at its first event.
    """
    at = F.struct(F.col("seq"), F.col("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    # The place of the last event that replaces the text; what follows it in the sorted log is appended.
    reset = F.array_max(F.transform("log", lambda e, k: F.when(e["kind"].isin(EDIT, REGENERATE), k)))
    last = F.get("log", F.col("reset"))
    base = F.when(last["kind"] == EDIT, last["text"]).otherwise(F.lit(""))
    since = F.filter("log", lambda e, k: (e["kind"] == DELTA) & (k > F.coalesce("reset", F.lit(-1))))
    regenerated = F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == REGENERATE), lambda e: e["seq"]))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    messages = (
        events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(at)).alias("log"))
        .withColumn("reset", reset)
        .select(
            "conv_id", "message",
            F.coalesce(F.get(roles, 0)["role"], F.lit("")).alias("role"),
            F.concat(F.coalesce(base, F.lit("")), F.array_join(F.transform(since, lambda e: e["text"]), "")).alias("text"),
            F.get("log", 0)["seq"].alias("started"), regenerated.alias("regenerated"),
        )
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("regenerated").over(before)
    return messages.withColumn("cut", cut).where("cut is null or started is null or started > cut") \
        .select("conv_id", "message", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the template text of each conversation and its loss mask.

    ``loss`` has an entry per turn: where the text under the loss starts in the turn and
    its length, in code points, escapes included; a turn without loss has length 0.
    Conversations are gathered by their id, a NULL id being one of its own.  A rendered
    conversation is one value, so its text has to fit into one task's memory.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    turn = F.concat(F.lit(OPEN), role, F.lit(SPLIT), text, F.lit(CLOSE))
    span = F.struct(
        (F.length(role) + len(OPEN) + len(SPLIT)).alias("start"),
        F.when(F.col("role") == loss_role, F.length(text)).otherwise(0).alias("length"),
    )
    turns = messages.select("conv_id", F.struct("message", turn.alias("turn"), span.alias("span")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.span").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): roles and texts of the turns, and the text under the mask.

    An escaped text holds no control string, so the marks can be split at.
    """
    pieces = F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size(F.split("formatted", CLOSE, -1)) - 1)

    def parsed(turn: Column) -> Column:
        body = F.substring(turn, len(OPEN) + 1, 1 << 30)
        return F.struct(
            unescape(F.substring_index(body, SPLIT, 1)).alias("role"),
            unescape(F.regexp_replace(body, r"(?s)^.*? \[/INST\] ", "")).alias("text"),
        )

    under = F.zip_with(pieces, "loss", lambda turn, span: F.when(
        span["length"] > 0, unescape(F.substring(turn, span["start"] + 1, span["length"]))).otherwise(F.lit("")))
    return formatted.select("conv_id", "formatted", F.transform(pieces, parsed).alias("turns"),
                            F.array_join(under, "").alias("loss_text"))


def events_of(rows: DataFrame) -> DataFrame:
    """The event log of finished turns: a start and deltas of up to 256 characters each.

    Rows that share a conversation and turn are ordered by role and text and are messages
    of their own, also when they repeat.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    count = F.ceil(F.length(text) / _DELTA_CHARS).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(
        (k + 1).cast("long").alias("seq"), F.lit(DELTA).alias("kind"), F.lit(None).cast("string").alias("role"),
        F.substring(text, k * _DELTA_CHARS + 1, F.lit(_DELTA_CHARS)).alias("text")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(START).alias("kind"), F.col("role").alias("role"),
                             F.lit(None).cast("string").alias("text")))
    log = F.concat(start, F.when(count > 0, deltas).otherwise(F.slice(start, 1, 0)))
    stride = 1 << 32
    return rows.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long")) \
        .select("conv_id", "message", F.explode(log).alias("e")) \
        .select("conv_id", (F.col("message") * stride + F.col("e.seq")).alias("seq"), "message", "e.kind", "e.role", "e.text")


_ROLE = r"regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"
_ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  {_ROLE} AS r, {_ROLE.replace("role", "text")} AS x FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(x) + {len(OPEN) + len(SPLIT) + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op6_chat", _ORACLE)
def op6_chat(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations", "conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    back = read_back(render(fold(events_of(rows.unionByName(extra)))))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
