"""Multi-party perspective rotation, in SQL functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; what the speaker says, with its end mark, is the span that training counts. System turns stay system
turns for everybody, and the system is no participant.

A rendering comes in parts, by 64 numbers of turns, and where more turns than that share such numbers (or have none) a part
comes in pieces of 64, so that no group of any size is gathered into one row. Joined in the order of ``part`` and
``piece`` they are the whole rendering, and ``start_char`` is where a piece begins in it. Starts are summed over
lengths alone; texts are shuffled once, and once more only in parts of several pieces.

Defined cases: a null text is empty, a long one stands whole in its piece; a null role is a user without a name and no
participant; turns of a null number come first, in part -1; equal numbers go by role and text, and repeated rows are
repeated turns; all rows of a null conv_id are one conversation; a conversation without participants gives no rows;
marks inside a text or a role are broken by a blank, and line ends in a role become blanks, so that neither can end its
turn or open another; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

TURNS = 64
START, END = "<|im_start|>", "<|im_end|>"
#: The name by which the others know a role.
_NAME = "case when role = 'system' then 'system' when role is null then 'user' else concat('user name=', translate(replace(role, '<|', '< |'), '\\r\\n', '  ')) end"


def _in_pieces(rows: DataFrame, turns: int) -> DataFrame:
    """rows (conv, part, turn, role, text) with their piece: dense numbers within a part, by ranges of sorted rows."""
    crowded = C.Table(rows.groupBy("conv", "part").count().filter(F.col("count") > turns).select(F.col("conv").alias("c"), F.col("part").alias("p")), "crowded").df
    none = F.col("part") - F.col("part")  # 0; a constant would fall out of the grouping, whose partitioning a join uses again
    if crowded.isEmpty():
        return rows.withColumn("piece", none)
    same = (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))
    single = rows.join(crowded, same, "left_anti").withColumn("piece", none)
    # Sorted ranges, so that any number of rows of one part is dealt over tasks; equal rows go by their place in the input.
    order = ["conv", "part", "turn", "role", "text", "tie"]
    many = rows.join(crowded, same, "left_semi").withColumn("tie", F.monotonically_increasing_id())
    many = C.Table(many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns").df
    many = many.withColumn("range", F.expr("shiftright(at, 33)"))
    ranges = many.groupBy("conv", "part", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv", "part").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"), (before - F.col("first")).alias("shift"))
    numbered = many.join(ranges, same & (F.col("range") == F.col("r"))).withColumn("piece", F.expr(f"(at + shift) div {turns}"))
    return single.unionByName(numbered.select(*single.columns))


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, participant, part, piece, n_turns, start_char, rendered, mask): mask holds start:end of the spans, in characters of the piece."""
    part = F.coalesce(F.floor(F.col("turn") / turns).cast("long"), F.lit(-1))
    # A struct is never null, so a null conv_id is a key like others, and what is grouped by it is dealt for joins too.
    rows = conversations.select(F.struct("conv_id").alias("conv"), part.alias("part"), "turn", "role", F.expr("replace(coalesce(text, ''), '<|', '< |')").alias("text"))
    rows = _in_pieces(rows, turns)
    # Lengths of each piece, by role; a participant's own turns have the name 'assistant' instead.
    fixed = len(START) + 1 + len(END) + 1
    by_role = rows.groupBy("conv", "part", "piece", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    by_role = by_role.withColumn("name", F.length(F.expr(_NAME)))
    by_role = C.Table(by_role.select("conv", "part", "piece", "role", (F.col("chars") + F.col("n") * (fixed + F.col("name"))).alias("size"), (F.col("n") * (len("assistant") - F.col("name"))).alias("own")), "lengths").df
    speakers = by_role.filter("role is not null and role <> 'system'")
    pieces = by_role.groupBy("conv", "part", "piece").agg(F.sum("size").alias("size"))
    grid = pieces.join(speakers.select(F.col("conv").alias("c"), F.col("role").alias("participant")).distinct(), (F.col("conv") == F.col("c"))).drop("c")
    said = speakers.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("piece").alias("q"), "role", "own")
    here = lambda: (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")) & (F.col("piece") == F.col("q"))
    grid = grid.join(said, here() & (F.col("participant") == F.col("role")), "left")
    before = F.sum(F.col("size") + F.coalesce("own", F.lit(0))).over(W.partitionBy("conv", "participant").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1))
    starts = grid.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("piece").alias("q"), "participant", F.coalesce(before, F.lit(0)).cast("long").alias("start_char"))
    texts = rows.groupBy("conv", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", F.expr(_NAME).alias("name")))).alias("turns"))  # TURNS at most
    both = texts.join(starts, here())
    head = f"concat('{START}', if(t.role = participant, 'assistant', t.name), '\\n')"
    seen = both.withColumn("segments", F.expr(f"transform(turns, t -> named_struct('own', coalesce(t.role = participant, false), 'head', {head}, 'body', concat(t.text, '{END}')))"))
    sums = (
        "aggregate(segments, named_struct('at', 0L, 'spans', cast(array() as array<string>)), (s, t) -> named_struct("
        "'at', s.at + length(t.head) + length(t.body) + 1L, 'spans', if(t.own, array_append(s.spans, concat(s.at + length(t.head), ':', s.at + length(t.head) + length(t.body))), s.spans)))"
    )
    out = seen.withColumns({"sums": F.expr(sums), "rendered": F.expr("array_join(transform(segments, t -> concat(t.head, t.body, '\\n')), '')")})
    return out.select("conv.conv_id", "participant", "part", "piece", F.size("turns").cast("long").alias("n_turns"), "start_char", "rendered", F.array_join("sums.spans", " ").alias("mask"))
