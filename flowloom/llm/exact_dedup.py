"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters deal the normalised texts into ranges, each range is sorted (Spark's external sort), equal texts
then stand next to each other, and each row is compared in full with its neighbour. A splitter is a text's prefix and
a hash of the id, so that a group of copies that is larger than a range is spread over several ranges; its runs, one
row for each range, are put together afterwards.

Cases: a null text counts as empty; all empty texts are equal. Ties in length go to the smallest id; a null id comes
after all others. Of wholly repeated rows exactly one is kept. An empty table gives no rows. Other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import own_columns, table, written

#: Characters that normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def splitters(keys: DataFrame, buckets: int, per_bucket: int, count: int) -> list[tuple[str, int]]:
    """At most buckets - 1 keys (prefix, tie) that cut a sample of about per_bucket keys for each bucket evenly. count: how many keys there are."""
    if not count:
        return []
    share = min(1.0, buckets * per_bucket / count)
    sample = keys.where(F.pmod(F.xxhash64(F.col("tie"), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    step = max(1, int(count * share) // buckets)
    ranked = sample.select("prefix", "tie", F.row_number().over(Window.orderBy("prefix", "tie")).alias("n"))
    return [(r.prefix, r.tie) for r in ranked.where(F.col("n") % step == 0).orderBy("n").limit(buckets - 1).collect()]


def bucket_of(prefix: Column, tie: Column, cuts: list[tuple[str, int]]) -> tuple[Column, Column]:
    """How many cuts are at or before a key (binary search: one fold over the step sizes), and an array of the cuts' prefixes."""
    prefixes, ties = (F.lit([c[i] for c in cuts]) for i in (0, 1))
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, size: Column) -> Column:
        i = at + size - 1
        p = F.get(prefixes, i)
        return F.when((p < prefix) | ((p == prefix) & (F.get(ties, i) <= tie)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step), prefixes


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, buckets: int | None = None, per_bucket: int = 32, prefix_chars: int = 256, range_bytes: int = 256 << 20, most_buckets: int = 20_000) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for each row of docs; with carry also row, the whole input row where kept (else null).

    buckets: ranges; unless given three for each shuffle partition, or one for each range_bytes of normalised text where
    these are more, up to most_buckets (which bounds the splitters; a range is sorted externally, whatever its size).
    per_bucket: sampled keys for each.
    """
    least = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("chars"), (F.struct(*own_columns(docs)) if carry else F.lit(None).cast("int")).alias("row"), normalised(text).alias("norm"), F.xxhash64(F.col(id_col)).alias("tie"))
    rows = rows.withColumn("prefix", F.substring("norm", 1, prefix_chars))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("norm").cast("bigint")).alias("bytes")).first()
    buckets = buckets or max(least, min(most_buckets, (size["bytes"] or 0) // range_bytes))
    cuts = splitters(rows.select("prefix", "tie"), buckets, per_bucket, size["rows"])
    bucket, shared = F.lit(0), F.lit(False)
    if cuts:
        bucket, prefixes = bucket_of(F.col("prefix"), F.col("tie"), cuts)
        shared = F.coalesce(F.get(prefixes, F.col("bucket") - 1) == F.col("prefix"), F.lit(False)) | F.coalesce(F.get(prefixes, F.col("bucket")) == F.col("prefix"), F.lit(False))
    rows = rows.withColumn("bucket", bucket).withColumn("shared", shared).drop("prefix")
    # With carry the texts move once, inside their rows, and are normalised again on the other side.
    tasks = (buckets, "bucket") if buckets > least else ("bucket",)
    rows = rows.drop("norm").repartition(*tasks).withColumn("norm", normalised(F.col("row")[text_col].cast("string"))) if carry else rows.repartition(*tasks)

    inside = Window.partitionBy("bucket").orderBy("norm", "tie")
    rows = rows.withColumns({"pos": F.row_number().over(inside), "before": F.lag("norm").over(inside)})
    rows = rows.select("bucket", "shared", "id", "chars", "row", "pos", (~F.col("norm").eqNullSafe(F.col("before"))).alias("new"), F.sha2(F.col("norm"), 256).alias("sha"))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("bucket", "run")
    rows = rows.withColumn("rank", F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("bucket").alias("b"), F.col("pos").alias("p")))
    rows = rows.withColumns({"best": F.min("rank").over(run), "size": F.count(F.lit(1)).over(run)})
    light = written(rows.select("bucket", "run", "new", "shared", "id", "sha", "rank", "best", "size", F.when(F.col("rank") == F.col("best"), F.col("row")).alias("row")), "sorted")

    # Runs whose prefix a splitter has may go on in other ranges: one row for each such run is put together by content.
    same = Window.partitionBy("sha")
    runs = light.where(F.col("shared") & F.col("new")).select("bucket", "run", F.min("best").over(same).alias("whole_best"), F.sum("size").over(same).alias("whole_size"))
    split = light.where("shared").join(runs, ["bucket", "run"]).drop("best", "size").withColumnsRenamed({"whole_best": "best", "whole_size": "size"})
    out = light.where(~F.col("shared")).unionByName(split)
    kept = F.col("rank") == F.col("best")
    out = out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), F.when(kept, F.col("row")).alias("row"))
    return out if carry else out.drop("row")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    return content_sort(docs, id_col, text_col, carry=True).where("kept").select("row.*")


def op8_exact_dedup(spark, sf_dir):
    return content_sort(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same rows by grouping on the normalised text.
SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS n,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

