"""Chat formatting: a finite-state machine over roles checks the order of turns, a declarative template emits segments.

A conversation of at most LONG turns is one array. A longer one, which no task could hold, is sorted over all tasks and cut into fragments of
LONG turns at most; a fragment is a function from the state before it to the state after it and the place where it stops, functions are
composed in two levels, and segments are numbered by the turns' places. Both ways give the same rows.

Cases: rows without conv_id are ignored; repeated rows count once; rows that tie on turn are ordered by role, then text, and stand
or fall by the machine; a missing turn, role or an unknown role makes the conversation invalid; a missing text is an empty one;
an invalid conversation gives one row with the position of the first offending turn (one past the last if the conversation ends in
a state that isn't final). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ._text import checkpointed

#: Most turns that are held together.
LONG = 4096


@dataclass(frozen=True)
class Role:
    """Text around a turn, and whether its content and end are trained on."""

    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Roles with their texts, the machine's moves (state, role) -> state, its first state and its final ones."""

    roles: dict[str, Role]
    moves: dict[tuple[str, str], str]
    first: str = "start"
    final: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))


CHAT = Template(
    roles={r: Role(f"<|{r}|>\n", "<|end|>\n", r == "assistant") for r in ("system", "user", "assistant")},
    moves={(s, r): r for s, r in [("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")]},
)


def _lookup(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _machine(template: Template) -> tuple[list[str], Column]:
    """States by number, and the moves as a map of "number>role"."""
    states = sorted({template.first, *template.final, *(s for s, _ in template.moves), *template.moves.values()})
    return states, _lookup({f"{states.index(s)}>{r}": F.lit(states.index(to)) for (s, r), to in template.moves.items()})


def _ran(ts: str, state: int, moves: Column) -> Column:
    """(state, pos, stopped) after the turns of an array: pos counts the moves, and once there is none the machine stops."""

    def step(acc: Column, t: Column) -> Column:
        to = F.when(t["turn"].isNotNull(), F.try_element_at(moves, F.concat(acc["state"].cast("string"), F.lit(">"), t["role"])))
        stopped = acc["stopped"] | to.isNull()
        return F.struct(F.when(stopped, acc["state"]).otherwise(to).alias("state"), (acc["pos"] + F.when(stopped, 0).otherwise(1)).cast("long").alias("pos"), stopped.alias("stopped"))

    return F.aggregate(ts, F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("stopped")), step)


def _composed(parts: Column, states: int) -> Column:
    """Outcomes by first state of fragments one after the other: parts has their own outcomes o."""

    def after(acc: Column, x: Column) -> Column:
        def one(a: Column) -> Column:
            o = F.get(x["o"], a["state"])
            return F.when(a["stopped"], a).otherwise(F.struct(o["state"].alias("state"), (a["pos"] + o["pos"]).alias("pos"), o["stopped"].alias("stopped")))

        return F.transform(acc, one)

    start = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("stopped")) for i in range(states)])
    return F.aggregate(parts, start, after)


def _segments(template: Template):
    def of(t: Column, attribute: str) -> Column:
        return F.try_element_at(_lookup({r: F.lit(getattr(x, attribute)) for r, x in template.roles.items()}), t["role"])

    def run(t: Column) -> Column:
        part = lambda text, loss: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"), loss.cast("long").alias("loss"))
        return F.array(part(of(t, "before"), F.lit(0)), part(t["text"], of(t, "loss")), part(of(t, "after"), of(t, "loss")))

    return run


def _judged(ends: DataFrame, states: list[str], template: Template) -> DataFrame:
    """valid and error_pos by the machine's outcome run."""
    good = ~F.col("run.stopped") & F.col("run.state").isin(*sorted(states.index(f) for f in template.final))
    return ends.withColumn("valid", good).withColumn("error_pos", F.when(~good, F.col("run.pos") + 1))


def _said(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("seg").cast("long").alias("seg"), "s.turn", "s.role", "s.text", "s.loss", "valid", "error_pos")


def _nothing() -> Column:
    return F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("loss"))


def _short(turns: DataFrame, template: Template) -> DataFrame:
    states, moves = _machine(template)
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("turn", "role", "text")))).alias("ts"))
    run = _judged(turns.withColumn("run", _ran("ts", states.index(template.first), moves)), states, template)
    every = F.when(F.col("valid"), F.flatten(F.transform("ts", _segments(template)))).otherwise(F.array(_nothing()))
    return _said(run.select("conv_id", "valid", "error_pos", F.posexplode(every).alias("seg", "s")))


def _long(turns: DataFrame, template: Template, most: int) -> DataFrame:
    states, moves = _machine(template)
    placed = numbered(turns.distinct(), "conv_id", "turn", "role", "text", name="place")
    block = F.floor(F.col("place") / most)
    pieces = placed.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("ts"))
    own = pieces.select("conv_id", "block", F.get("ts", F.lit(0))["place"].alias("first"), F.array(*[_ran("ts", i, moves) for i in range(len(states))]).alias("o"))
    for by in (F.floor(F.col("block") / most), F.lit(0).cast("long")):
        parts = F.sort_array(F.collect_list(F.struct("block", "o")))
        own = own.groupBy("conv_id", by.alias("by")).agg(F.min("first").alias("first"), _composed(parts, len(states)).alias("o")).withColumnRenamed("by", "block")
    ends = checkpointed(_judged(own.select("conv_id", "first", F.get("o", F.lit(states.index(template.first))).alias("run")), states, template).drop("run"))
    parts = pieces.join(ends.where("valid"), "conv_id").select("conv_id", "valid", "error_pos", (F.get("ts", F.lit(0))["place"] - F.col("first")).alias("skip"), F.posexplode(F.flatten(F.transform("ts", _segments(template)))).alias("k", "s"))
    wrong = ends.where("not valid").select("conv_id", "valid", "error_pos", F.lit(0).alias("seg"), _nothing().alias("s"))
    return _said(parts.withColumn("seg", 3 * F.col("skip") + F.col("k"))).unionByName(_said(wrong))


def format_chats(conversations: DataFrame, template: Template = CHAT, most: int = LONG) -> DataFrame:
    """Segments (conv_id, seg, turn, role, text, loss, valid, error_pos), in order of seg within a conversation."""
    c = conversations
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.lower(F.trim(c["role"])).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    long_ = checkpointed(turns.groupBy("conv_id").count().where(F.col("count") > most).select("conv_id"))
    if long_.isEmpty():
        return _short(turns, template)
    return _short(turns.join(long_, "conv_id", "left_anti"), template).unionByName(_long(turns.join(long_, "conv_id", "left_semi"), template, most))


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, lower(trim(role)) AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w, 'start') AS prev, count(*) OVER (PARTITION BY conv_id) AS n
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
b AS (SELECT *, CASE WHEN turn IS NOT NULL AND prev || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN 0 ELSE 1 END AS bad FROM o),
v AS (SELECT conv_id, coalesce(min(CASE WHEN bad = 1 THEN pos END), CASE WHEN max(CASE WHEN pos = n THEN role END) = 'assistant' THEN NULL ELSE max(n) + 1 END) AS error_pos FROM b GROUP BY conv_id)
SELECT conv_id, CAST(3 * (pos - 1) + k AS BIGINT) AS seg, turn, role,
       CASE k WHEN 0 THEN '<|' || role || '|>' || chr(10) WHEN 1 THEN text ELSE '<|end|>' || chr(10) END AS text,
       CAST(CASE WHEN k > 0 AND role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS loss, true AS valid, CAST(NULL AS BIGINT) AS error_pos
FROM b JOIN v USING (conv_id), (VALUES (0), (1), (2)) AS s(k) WHERE v.error_pos IS NULL
UNION ALL SELECT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), false, CAST(error_pos AS BIGINT) FROM v WHERE error_pos IS NOT NULL
"""
