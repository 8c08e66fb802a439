"""Files whose rows are blobs have small row groups, so neither writer nor reader holds a task's text at once."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelforge.llm import substrings


def test_row_groups_of_chunks_are_bounded(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16_384)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)), "")
    docs = spark.range(0, 32, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    table, name = substrings.chunked(substrings.plain(docs, F.lit(None).cast("boolean")), 2)
    try:
        sizes = []
        for f in table.inputFiles():
            m = pq.ParquetFile(f.removeprefix("file:")).metadata
            sizes += [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]
        assert sum(sizes) > 32 << 20 and max(sizes) < 12 << 20
        assert table.select(F.explode("text")).distinct().count() == 32
    finally:
        spark.sql(f"DROP TABLE {name}")
