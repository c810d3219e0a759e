"""Parts that Arrow passes hand to their work."""

import pyarrow as pa
from pyspark.sql import functions as F

from basketry.llm.common import arrow_pass


def test_large_batches_are_worked_on_in_parts(spark):
    rows = spark.range(0, 3000, 1, 2).select("id", F.repeat(F.lit("x"), 1000).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.array([batch.num_rows] * batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), held], ["id", "held"])

    found = arrow_pass(rows, work, "id bigint, held bigint", 100_000).agg(F.count("id"), F.count_distinct("id"), F.max("held")).first()
    assert found[:2] == (3000, 3000) and 10 <= found[2] <= 100
    assert arrow_pass(rows.limit(0), work, "id bigint, held bigint", 100_000).count() == 0
