"""A program over grids that arrive as files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessel.plans.programs import Program, run
from tessel.sources.grids import to_cells


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, program: Program) -> StreamingQuery:
    """Reads Parquet files of gid, h, w, g, err from ``source`` as they appear and writes the cells of the
    program's results to ``sink``, each batch to a folder of its own number.  Rows are independent, so the
    stream keeps no state; a restart from the checkpoint goes on where it stopped, and a batch that runs
    again replaces what it wrote before."""
    schema = "gid long, h int, w int, g array<array<int>>, err string"
    grids = spark.readStream.schema(schema).parquet(source)

    def each(batch, number: int) -> None:
        to_cells(run(batch, program)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return grids.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
