"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn becomes ``<|turn|>role\\ntext<|end|>\\n``.  A turn's size is an estimate of its tokens,
as no tokenizer is a DataFrame function: one for every four characters of its text, rounded
up, and ``OVERHEAD`` for its marks.

Prefix sums of the sizes choose spans of whole turns.  A question and the answers that
follow it are one part, where a window has room for them; otherwise each of their turns is.
A part of more than a quarter of the room is a span of its own, and the others between two
such are cut by prefix sums: a part belongs to the span in which it starts, spans being as
long as the room less the longest of these parts.  So a window keeps within the budget, and
a long turn doesn't shorten the windows of other turns.  (A turn that is longer than the
room has a window marked ``over_budget``.)  A window after the first repeats the system turn,
if the conversation starts with one, and the last ``HISTORY_TURNS`` turns as far as they fit
``HISTORY`` tokens; where it opens with an answer, the turn before is also repeated if it fits
what the window leaves of the budget.  The loss mask covers each assistant text once:
repeated turns are outside.

Control strings inside texts and roles are escaped reversibly: a backslash becomes
``\\0``, the first letter of ``<|``, ``<s>``, ``</s>`` ``\\1``, that of ``[INST]``, ``[/INST]`` ``\\2``,
and a line break in a role ``\\3``.

A conversation's turns are one partition of the window functions, which stream over
it; a window's group is bounded by the budget.

Edge cases: null text or role is empty; null turns come first; turns of one number are
ordered by role and text, and all are kept; rows without conv_id are one conversation.
Columns other than these four are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.shared import table

BUDGET, HISTORY, HISTORY_TURNS, OVERHEAD = 2048, 256, 2, 4
TURN, END = "<|turn|>", "<|end|>"
#: Control string and what it becomes, in the order of replacement.
ESCAPES = (("\\", "\\0"), ("<|", "\\1|"), ("<s>", "\\1s>"), ("</s>", "\\1/s>"), ("[INST]", "\\2INST]"), ("[/INST]", "\\2/INST]"))


def escaped(text: Column) -> Column:
    for control, instead in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(instead))
    return text


def unescaped(text: Column) -> Column:
    for instead, control in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(instead), F.lit(control))
    return text


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window int, n_repeated int, tokens long, over_budget boolean, formatted string, loss array<struct<start, end>>).

    ``loss`` holds spans of characters of ``formatted``, end excluded, in order.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    mark = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\3")), F.lit("\n"))
    rows = rows.select(
        "conv_id",
        F.row_number().over(by).alias("pos"),
        "role",
        F.length(mark).alias("before"),
        F.concat(mark, escaped(F.col("text")), F.lit(END + "\n")).alias("piece"),
        (OVERHEAD + F.floor((F.length("text") + 3) / 4)).alias("tokens"),
    )
    by = Window.partitionBy("conv_id").orderBy("pos")
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("system_tokens", F.max(F.when(system, F.col("tokens")).otherwise(0)).over(whole))
    each = lambda *names: Window.partitionBy("conv_id", *names)
    number = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).over(by)
    rows = rows.withColumn("room", F.lit(budget - history) - F.col("system_tokens"))
    rows = rows.withColumn("asks", (F.col("pos") == 1) | (F.col("role") != "assistant")).withColumn("unit", number(F.col("asks")))
    rows = rows.withColumn("first", F.col("asks") | (F.sum("tokens").over(each("unit")) > F.col("room"))).withColumn("part", number(F.col("first")))
    rows = rows.withColumn("part_tokens", F.sum("tokens").over(each("part")))
    rows = rows.withColumn("big", F.col("part_tokens") > F.greatest(F.lit(1), F.floor(F.col("room") / 4)))
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.col("room") - F.max(F.when(F.col("big"), 0).otherwise(F.col("part_tokens"))).over(whole)))
    rows = rows.withColumn("stretch", 2 * number(F.col("big") & F.col("first")) - F.col("big").cast("int"))
    rows = rows.withColumn("start", F.sum("tokens").over(each("stretch").orderBy("pos")) - F.col("tokens"))
    rows = rows.withColumn("cut", F.floor(F.min("start").over(each("part")) / F.col("stride")))
    rows = rows.withColumn("opens", F.coalesce((F.lag("stretch").over(by) != F.col("stretch")) | (F.lag("cut").over(by) != F.col("cut")), F.lit(False)))
    rows = rows.withColumn("span", number(F.col("opens")))
    rows = rows.withColumn("left", F.lit(budget) - F.col("system_tokens") - F.sum("tokens").over(each("span")))

    # What a later window repeats, on the row of its first turn.
    rows = rows.withColumn("system", F.first(F.when(system, F.col("piece"))).over(by))
    kept, used = [], F.lit(0)
    for back in range(1, HISTORY_TURNS + 1):
        lag = lambda name, back=back: F.lag(name, back).over(by)
        used = used + lag("tokens")
        isn_system = ~((F.col("pos") == back + 1) & F.col("system").isNotNull())
        limit = F.when(F.col("role") == "assistant", F.greatest(F.lit(history), F.col("left"))).otherwise(history) if back == 1 else F.lit(history)
        fits = F.col("opens") & (F.col("pos") > back) & (used <= limit) & isn_system
        kept.append(F.when(fits, lag("piece")))
    repeated = F.when(F.col("opens"), F.array_compact(F.array(F.col("system"), *reversed(kept))))
    rows = rows.withColumn("repeated", repeated)
    repeated_tokens = F.when(F.col("opens"), F.col("system_tokens")).otherwise(0)
    used = F.lit(0)
    for back, piece in enumerate(kept, 1):
        repeated_tokens = repeated_tokens + F.when(piece.isNotNull(), F.lag("tokens", back).over(by)).otherwise(0)
    rows = rows.withColumn("repeated_tokens", repeated_tokens)
    rows = rows.withColumn("head", F.coalesce(F.array_join("repeated", ""), F.lit("")))

    inside = Window.partitionBy("conv_id", "span").orderBy("pos")
    rows = rows.withColumn("at", F.sum(F.length("piece") + F.length("head")).over(inside) - F.length("piece"))
    target = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("before")).cast("int").alias("start"), (F.col("at") + F.length("piece") - len(END) - 1).cast("int").alias("end")))
    grouped = rows.groupBy("conv_id", "span").agg(
        F.sum(F.coalesce(F.size("repeated"), F.lit(0))).cast("int").alias("n_repeated"),
        (F.sum("tokens") + F.sum("repeated_tokens")).alias("tokens"),
        F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "piece").alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(target)).alias("loss"),
    )
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1
    return grouped.select(
        "conv_id", number.cast("int").alias("window"), "n_repeated", "tokens", (F.col("tokens") > budget).alias("over_budget"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Of each conversation, from its windows alone: its turns and its text under the loss mask, each once and in order."""
    pieces = F.split("formatted", "<\\|turn\\|>")
    turns = F.slice(pieces, F.col("n_repeated") + 2, F.size(pieces))
    text = lambda t: F.substr(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - F.lit(len(END) + 1))
    plain = F.transform(turns, lambda t: F.concat(unescaped(F.substring_index(t, "\n", 1)), F.lit("\n"), unescaped(text(t)), F.lit("\n")))
    target = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = formatted.select("conv_id", "window", F.size(turns).alias("n"), F.array_join(plain, "").alias("turns"), F.array_join(target, "").alias("loss_text"), F.length("formatted").alias("chars"))
    listed = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("windows"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("windows", lambda w: w[name]), "")
    return listed.select("conv_id", "n_turns", joined("turns").alias("turns"), joined("loss_text").alias("loss_text"), "formatted_chars")


_TRICKY = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"))
    back = read_back(windows(turns.unionByName(own)))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return back.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), digest("turns").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest("loss_text").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def _sql_escaped(text: str) -> str:
    for control, instead in ESCAPES:
        text = f"replace({text}, '{control}', '{instead}')"
    return text


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    {OVERHEAD} + (length(text) + 3) // 4 AS tokens,
    {len(TURN) + len(END) + 2} + length(replace({_sql_escaped("role")}, chr(10), '\\3')) + length({_sql_escaped("text")}) AS chars
  FROM t
), b AS (
  SELECT *, {BUDGET - HISTORY} - st AS room, (pos = 1 OR role <> 'assistant') AS asks FROM (SELECT *,
    max(CASE WHEN pos = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS st,
    max(CASE WHEN pos = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sc FROM a)
), b1 AS (SELECT *, sum(asks::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS unit FROM b
), b2 AS (SELECT *, asks OR sum(tokens) OVER (PARTITION BY conv_id, unit) > room AS first FROM b1
), b3 AS (SELECT *, sum(first::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS part FROM b2
), b4 AS (SELECT *, pt > greatest(1, floor(room / 4)) AS big FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, part) AS pt FROM b3)
), b5 AS (SELECT *, greatest(1, room - max(CASE WHEN big THEN 0 ELSE pt END) OVER (PARTITION BY conv_id)) AS stride, 2 * sum((big AND first)::INT) OVER (PARTITION BY conv_id ORDER BY pos) - big::INT AS stretch FROM b4
), b6 AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, stretch ORDER BY pos) - tokens AS start FROM b5
), b7 AS (SELECT *, min(start) OVER (PARTITION BY conv_id, part) // stride AS cut FROM b6
), b8 AS (SELECT *, coalesce(lag(stretch) OVER w <> stretch OR lag(cut) OVER w <> cut, false) AS opens FROM b7 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), c AS (
  SELECT *, {BUDGET} - st - sum(tokens) OVER (PARTITION BY conv_id, span) AS unused FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS span FROM b8)
), d AS (
  SELECT *, lag(tokens, 1) OVER w AS t1, lag(tokens, 2) OVER w AS t2, lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN opens THEN sc
    + CASE WHEN pos > 1 AND t1 <= CASE WHEN role = 'assistant' THEN greatest({HISTORY}, unused) ELSE {HISTORY} END AND NOT (pos = 2 AND st > 0) THEN c1 ELSE 0 END
    + CASE WHEN pos > 2 AND t1 + t2 <= {HISTORY} AND NOT (pos = 3 AND st > 0) THEN c2 ELSE 0 END
    ELSE 0 END)::BIGINT AS formatted_chars
FROM d GROUP BY conv_id
"""
