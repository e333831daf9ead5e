"""Task files: JSON records and challenges in, exports and submissions out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

GRID = "array<array<int>>"
PAIRS = f"array<struct<input: {GRID}, output: {GRID}>>"
RECORD = f"id string, train {PAIRS}, test {PAIRS}, program array<struct<op: string, params: string>>, program_text string, ops array<string>, categories array<string>, input_generator string, family string, story string, tags array<string>"
CHALLENGE = f"map<string, struct<train: {PAIRS}, test: {PAIRS}>>"


def read_records(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """One record a line; ``tolerant`` leaves out lines that are no JSON, as in a file still being written."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_challenges(spark: SparkSession, path: str) -> DataFrame:
    """(id, train, test) from files that hold one object of tasks by id."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", CHALLENGE)).alias("id", "task")).select("id", "task.train", "task.test")


def with_solutions(spark: SparkSession, tasks: DataFrame, path: str) -> DataFrame:
    """``tasks`` with the outputs of their tests from files that hold one object of output lists by id."""
    files = spark.read.text(path, wholetext=True)
    found = files.select(F.explode(F.from_json("value", f"map<string, array<{GRID}>>")).alias("id", "outputs"))
    joined = tasks.join(found, "id", "left")
    solved = F.transform("test", lambda t, i: t.withField("output", F.coalesce(F.get("outputs", i), t["output"])))
    return joined.withColumn("test", solved).drop("outputs")


def placed(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in an order; ties in any order.

    A bounded sample of the values cuts the rows into ranges; a row's place is its number within its range, after the rows
    of all ranges before.  So no task sees more than a range, and any cuts give the same places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(F.col(order).alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v")).limit(64 * parts).orderBy("v").collect()
    cuts = [row["v"] for row in some][64::64]
    kind = df.schema[order].dataType
    value = lambda v: (F.struct(*map(F.lit, v)) if isinstance(v, Row) else F.lit(v)).cast(kind)
    bucket = F.size(F.filter(F.array(*map(value, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_range", F.coalesce(bucket, F.lit(0)))
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # one row for each range
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return rows.withColumn(name, number + F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_range"))).drop("_range")


def part(df: DataFrame, order: str, offset: int = 0, limit: int | None = None, stride: int = 1, shards: int = 1, shard: int = 0) -> DataFrame:
    """Some rows by their place in an order: after ``offset``, every ``stride``-th, one of several shards of these, the first ``limit``."""
    at = F.col("_at") - offset
    picked = placed(df, order, "_at").where((at >= 0) & (at % stride == 0) & (F.floor(at / stride) % shards == shard))
    if limit is not None:  # the shard's number of a row says how many of its rows are before
        picked = picked.where(F.floor(F.floor(at / stride) / shards) < limit)
    return picked.drop("_at")


def grids(tasks: DataFrame, split: str = "train") -> DataFrame:
    """(task_id, idx, g, wanted, h, w, err): a task's pairs as rows."""
    rows = tasks.select(F.col("id").alias("task_id"), F.posexplode(split).alias("idx", "pair"))
    g = F.col("pair.input")
    return rows.select("task_id", "idx", g.alias("g"), F.col("pair.output").alias("wanted"), F.size(g).alias("h"), F.size(F.get(g, F.lit(0))).alias("w"), F.lit(None).cast("string").alias("err"))


def grid_text(grid: F.Column) -> F.Column:
    """Digits, a line for each row."""
    return F.array_join(F.transform(grid, lambda row: F.array_join(row.cast("array<string>"), "")), "\n")


def prompts(tasks: DataFrame, most: int | None = None) -> DataFrame:
    """(id, prompt, completion): the demonstrations and one test input as text, and its output.

    With ``most``, demonstrations are left out from the last one on until the prompt has at most so many characters.
    """
    one = F.transform("train", lambda p: F.concat(F.lit("INPUT\n"), grid_text(p["input"]), F.lit("\nOUTPUT\n"), grid_text(p["output"]), F.lit("\n")))
    rows = tasks.select("id", one.alias("shown"), F.explode("test").alias("pair"))
    asked = F.concat(F.lit("INPUT\n"), grid_text(F.col("pair.input")), F.lit("\nOUTPUT\n"))
    shown = F.col("shown")
    if most is not None:
        upto = lambda i: F.aggregate(F.slice(shown, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
        shown = F.filter(shown, lambda _, i: upto(i) + F.length(asked) <= most)
    return rows.select("id", F.concat(F.array_join(shown, ""), asked).alias("prompt"), grid_text(F.col("pair.output")).alias("completion"))


def side_by_side(pairs: DataFrame) -> DataFrame:
    """(task_id, idx, text): a pair's grids beside each other, a line for each row, spaces for background."""
    row = lambda g, w, i: F.rpad(F.translate(F.array_join(F.coalesce(F.get(g, i).cast("array<string>"), F.array().cast("array<string>")), ""), "0", "."), w, " ")
    width = lambda g: F.coalesce(F.array_max(F.transform(g, lambda x: F.size(x))), F.lit(0))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.size("g"), F.size("wanted"), F.lit(1)) - 1), lambda i: F.concat(row(F.col("g"), width(F.col("g")), i), F.lit(" | "), row(F.col("wanted"), width(F.col("wanted")), i)))
    return pairs.select("task_id", "idx", F.array_join(lines, "\n").alias("text"))


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record a line."""
    records.write.mode("errorifexists").json(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One folder for each task id with its JSON object of train and test."""
    tasks.select("id", F.to_json(F.struct("train", "test")).alias("value")).repartition("id").write.mode("errorifexists").partitionBy("id").text(path)


def stats(records: DataFrame, known: DataFrame, seed: int = 0) -> DataFrame:
    """One row: tasks, seed, program_lengths and op_counts as maps, unused_ops; ``known``: op."""
    counted = lambda frame, name: frame.groupBy(name).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "count")))))  # noqa: E731  operators and lengths are few
    lengths = counted(records.select(F.size("ops").alias("length")), "length").toDF("program_lengths")
    used = records.select(F.explode("ops").alias("op"))
    unused = known.join(used.distinct(), "op", "left_anti").agg(F.array_sort(F.collect_list("op")).alias("unused_ops"))
    rows = records.agg(F.count(F.lit(1)).alias("tasks"), F.lit(seed).alias("seed"))
    return rows.crossJoin(lengths).crossJoin(counted(used, "op").toDF("op_counts")).crossJoin(unused)  # one row each


def write_submission(tried: DataFrame, path: str) -> None:
    """One line for each task: its id and the two attempts for each of its tests, from (id, test, attempt_1, attempt_2)."""
    each = tried.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("test", "attempt_1", "attempt_2"))).alias("tests"))
    attempts = F.transform("tests", lambda t: F.struct(t["attempt_1"].alias("attempt_1"), t["attempt_2"].alias("attempt_2")))
    each.select("id", attempts.alias("attempts")).write.mode("errorifexists").json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't in the Parquet table at ``path`` yet, so that an interrupted job can go on.

    For one writer; jobs that may run twice at once keep their rows in a ``tessel.plans.store.Results``.
    """
    try:
        df = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException:  # no table yet
        pass
    df.write.mode("append").parquet(path)
