"""What tasks over archives hold at a time is bounded by rows and bytes, not by the size of a partition."""

from pyspark.sql import functions as F

from sieveline.batches import BATCH_ROWS
from sieveline.plans.triage import decoded
from sieveline.sources.build import TEXTS, packed


def test_archives_are_packed_from_bounded_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        n = 2 * BATCH_ROWS + 500
        docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word 10.1.2.3 own"), "id").alias("text"))
        t = decoded(packed(docs))
        # A batch's last archive is not filled up with the next batch's texts.
        assert t.files.count() == 2 * -(-BATCH_ROWS // TEXTS) + -(-500 // TEXTS)
        found = t.classes.filter("status = 'parsed'").select("name", F.explode("strings").alias("s"))
        assert found.filter("s = concat('own', regexp_extract(name, '^d/([0-9]+)_', 1))").count() == n and found.count() == 3 * n
        t.discard()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
