"""Chat formatting: every participant's view of a dialogue.

For each one who speaks, the dialogue is rendered with that speaker as the assistant
and the others as named users; the masks mark what the assistant says, the part a
model learns from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table

SYSTEM = "system"
UNNAMED = "unknown"
START, END = "<|im_start|>", "<|im_end|>"
TURNS = 256


def plain(text: Column) -> Column:
    """Text in which the markers of the format cannot occur: a marker's ``<|`` is
    parted by a blank."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _named(turns: DataFrame, conversation: str, turn: str, speaker: str, text: str) -> DataFrame:
    return turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said"),
    )


def _placed() -> Column:
    return F.col("conv_id").isNotNull() & F.col("turn").isNotNull()


def _pieces() -> Column:
    """The ``turns`` of a row as ``participant`` sees them."""

    def rendered(one: Column) -> Column:
        own = one["speaker"] == F.col("participant")
        head = (
            F.when(one["speaker"] == SYSTEM, F.lit(SYSTEM))
            .when(own, F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), plain(one["speaker"])))
        )
        head = F.concat(F.lit(START), head, F.lit("\n"))
        said = F.concat(plain(one["said"]), F.lit(END))
        return F.struct(
            F.concat(head, said, F.lit("\n")).alias("piece"),
            F.char_length(head).cast("long").alias("skip"),
            F.char_length(said).cast("long").alias("length"),
            own.alias("own"),
        )

    return F.transform("turns", rendered)


def _masks(first: Column) -> Column:
    """Spans of the own ones of ``pieces``, the first of which begins at ``first``."""
    # Bounded by turns_each, so growing an array span by span stays cheap.
    return F.aggregate(
        "pieces",
        F.struct(
            first.cast("long").alias("at"),
            F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"),
        ),
        lambda state, piece: F.struct(
            (state["at"] + F.char_length(piece["piece"])).alias("at"),
            F.when(
                piece["own"],
                F.array_append(
                    state["spans"],
                    F.struct(
                        (state["at"] + piece["skip"]).alias("start"),
                        piece["length"].alias("length"),
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
        lambda state: state["spans"],
    )


def perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    turns_each: int = TURNS,
) -> DataFrame:
    """One row per window of turn numbers and participant; whole dialogues are in
    :func:`whole_views`.

    Columns ``conv_id``, ``part``, ``participant``, ``n_turns``, ``text``, and
    ``masks``: structs of the first character and the length of each span that the
    participant speaks, its end marker included.

    A part has the turns numbered from ``part * turns_each`` up to the next part, so
    a dialogue of any length is rendered in rows of bounded size, and only rows of
    one part meet in one task. Who speaks in a part has a view of it. ``system`` is
    no participant and keeps its role in every view; a part in which nobody else
    speaks has no view. Turns are ordered by number, then speaker, then text; a row
    that is there twice is rendered once. A null speaker is called ``unknown``, a null
    text is empty, and a row without conversation or turn number is a dialogue of
    its own, ``part`` null.
    """
    placed = _placed()
    named = _named(turns, conversation, turn, speaker, text)
    # Repeated rows go in each task, before anything is shuffled by conversation.
    # What stands alone is grouped by its own content, not with all other such rows.
    parts = (
        named.withColumn("part", F.when(placed, F.floor(F.col("turn") / turns_each)))
        .withColumn("alone", F.when(~placed, F.xxhash64("turn", "speaker", "said")))
        .groupBy("conv_id", "part", "alone")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "speaker", "said"))).alias("turns"))
    )
    speakers = F.array_remove(F.array_distinct(F.col("turns.speaker")), SYSTEM)
    views = parts.select("conv_id", "part", "turns", F.explode(speakers).alias("participant"))

    views = views.withColumn("pieces", _pieces())
    return views.select(
        "conv_id",
        "part",
        "participant",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("pieces.piece", "").alias("text"),
        _masks(F.lit(0)).alias("masks"),
    )


def whole_views(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    turns_each: int = TURNS,
) -> DataFrame:
    """Every participant's view of every whole dialogue, in rows of bounded size.

    Columns as in :func:`perspectives`, and ``first_char``, where a part begins in the
    view; the texts of a view's parts put together in order are the view, and ``masks``
    count from its start. Turns are ordered by number, then speaker, then text, and a
    part has the next ``turns_each`` of them, whatever their numbers are. Who speaks
    anywhere in a dialogue has a view of all of it, the system's turns included. A row
    that is there twice is rendered twice. A row without conversation or turn number is
    a dialogue of its own, ``part`` null.

    The rows of a dialogue are numbered and its views placed in one task, one row after
    the other; no more than a part is held as one value.
    """
    named = _named(turns, conversation, turn, speaker, text)
    one = F.struct("turn", "speaker", "said")
    order = Window.partitionBy("conv_id").orderBy("turn", "speaker", "said")
    placed = named.filter(_placed())
    parts = (
        placed.withColumn("part", F.floor((F.row_number().over(order) - 1) / turns_each))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(one)).alias("turns"))
    )
    speakers = placed.filter(F.col("speaker") != SYSTEM)
    speakers = speakers.select("conv_id", F.col("speaker").alias("participant")).distinct()
    view = Window.partitionBy("conv_id", "participant").orderBy("part")
    size = F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda total, x: total + F.char_length(x["piece"])
    )
    views = (
        parts.join(speakers, "conv_id")
        .withColumn("pieces", _pieces())
        .withColumn("size", size)
        .withColumn("first_char", F.sum("size").over(view) - F.col("size"))
    )
    alone = (
        named.filter(~_placed() & (F.col("speaker") != SYSTEM))
        .select(
            "conv_id",
            F.lit(None).cast("long").alias("part"),
            F.array(one).alias("turns"),
            F.col("speaker").alias("participant"),
        )
        .withColumn("pieces", _pieces())
        .withColumn("first_char", F.lit(0).cast("long"))
    )
    columns = ["conv_id", "part", "participant", "turns", "pieces", "first_char"]
    return (
        views.select(*columns)
        .unionAll(alone.select(*columns))
        .select(
            "conv_id",
            "part",
            "participant",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join("pieces.piece", "").alias("text"),
            _masks(F.col("first_char")).alias("masks"),
            "first_char",
        )
    )


OP7_SQL = """
WITH named AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
    row_number() OVER () AS row_no, conv_id IS NULL OR turn IS NULL AS loose
  FROM conversations
), turns AS (
  SELECT *, CASE WHEN loose THEN row_no END AS alone,
    row_number() OVER (PARTITION BY conv_id, loose ORDER BY turn, speaker, said) - 1 AS place
  FROM named
), views AS (
  SELECT DISTINCT conv_id, alone, speaker AS participant FROM turns WHERE speaker <> 'system'
), pieces AS (
  SELECT v.*, n.speaker, n.place, CASE WHEN n.alone IS NULL THEN n.place // 256 END AS part,
    '<|im_start|>' || CASE WHEN n.speaker = 'system' THEN 'system'
      WHEN n.speaker = v.participant THEN 'assistant'
      ELSE 'user name=' || replace(n.speaker, '<|', '< |') END || chr(10) AS head,
    replace(n.said, '<|', '< |') || '<|im_end|>' AS body
  FROM views v JOIN turns n
    ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.alone IS NOT DISTINCT FROM n.alone
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, alone, participant ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_char FROM pieces
)
SELECT conv_id, part, participant, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg((first_char + length(head))::VARCHAR || ':' || length(body)::VARCHAR, ','
    ORDER BY place) FILTER (WHERE speaker = participant), '') AS masks
FROM placed GROUP BY conv_id, alone, part, participant
"""


@query("op7_chat_perspectives", OP7_SQL)
def op7_chat_perspectives(spark, sf_dir):
    spans = F.transform("masks", lambda m: F.concat(m["start"], F.lit(":"), m["length"]))
    views = whole_views(read_table(spark, sf_dir, "conversations")).drop("first_char")
    return views.withColumn("masks", F.array_join(spans, ","))
