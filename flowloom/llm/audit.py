"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document's failures are five bits. Spark counts the documents for each part, failures and labels, so what goes on is
at most 32 masks by 4 labels for each part. For these, min-plus removal ranks: the mask matrix (0 where a filter fails
the document, infinite elsewhere) and the position matrix of the orders (the inverse permutations) are combined by
minimum, which gives the step at which each mask leaves in each order; kept, removed and lost documents are scatter
counts over these steps, weighted by the documents, and a filter's redundancies are failures removed at an earlier step.

Filters: A under 100 words; B fewer than 80 % of the words distinct; C more than 10 % of the code points A-Z; D any of
`#$%&*|`; E the text of a smaller id again, table-wide. Texts are compared by their SHA-256: the least id of each comes
from an aggregation that is summed up before the shuffle, so a text that a third of all rows have is no large task, and
the ids that have it are found by a join on (text, id).

Cases: a null text is empty (0 words: fails A only, and E as other empty texts do). Rows without an id never fail E and
no row fails E for them; they have no labels. Of repeated rows with the least id of a text none fails E. Several labels
of one id: any 1 counts. A null part and an empty one are the same. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import table, written

FILTERS = "ABCDE"
#: All orders, and for each the place of each filter in it, from 1: the inverse permutations.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
POSITIONS = np.array([[order.index(f) + 1 for f in FILTERS] for order in ORDERS], float)
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column, words: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D. words: an array."""
    n, upper = F.size(words), F.char_length(F.regexp_replace(text, "[^A-Z]++", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * upper > 10 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def signs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, mask (A to D), sha, good, toxic of each row; no text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", f"[{BLANKS}]++"), lambda w: w != ""))
    rows = rows.select("id", "part", failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))
    # Rows without an id are dealt over many keys that no label has.
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha", F.monotonically_increasing_id()), F.lit(4096)) + 1).otherwise(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    out = rows.join(known.withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    return out.select("id", "part", "mask", "sha", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """part, mask (A to E), good, toxic, n from signs(): rows that are the first of their text, and all others."""
    keys = ["part", "mask", "good", "toxic"]
    first = rows.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id"))
    passing = rows.join(first, ["sha", "id"], "left_semi").unionByName(rows.where("id IS NULL"))
    passing = passing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys[:1], (F.col("mask") + 16).alias("mask"), *keys[2:], "n")
    again = passing.select("part", (F.col("mask") + 16).alias("mask"), "good", "toxic", (-F.col("n")).alias("n"))
    return passing.select(*keys, "n").unionByName(both).unionByName(again).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def removal_ranks(masks: np.ndarray) -> np.ndarray:
    """The step (1 to 5; infinite: never) at which each mask (rows) leaves in each order (columns): the min-plus product of masks and positions."""
    fails = np.where((masks[:, None] >> np.arange(len(FILTERS))) & 1 > 0, 0.0, np.inf)
    return (fails[:, None, :] + POSITIONS[None, :, :]).min(axis=2)


def audited(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS for each part of mask_counts()."""
    kind = f"part {counts.schema['part'].dataType.simpleString()}, filter_order string, step int, {', '.join(f'{c} bigint' for c in COUNTS)}"
    orders, steps = len(ORDERS), len(FILTERS)
    letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        masks, n = rows["mask"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        ranks = removal_ranks(masks)
        at = np.where(np.isfinite(ranks), ranks, steps + 1).astype(int)

        def scattered(weights: np.ndarray) -> np.ndarray:
            out = np.zeros((orders, steps + 2), np.int64)
            np.add.at(out, (np.broadcast_to(np.arange(orders), at.shape), at), weights[:, None])
            return out[:, 1:]

        removed = scattered(n)
        failing = np.array([n[masks >> f & 1 > 0].sum() for f in range(steps)])
        alone = np.array([n[masks == 1 << f].sum() for f in range(steps)])
        shapley = np.zeros(steps, np.int64)
        np.add.at(shapley, letter, removed[:, :steps])
        columns = {
            "kept": n.sum() - removed[:, :steps].cumsum(axis=1), "removed": removed[:, :steps], "redundant": failing[letter] - removed[:, :steps], "unique_fails": alone[letter],
            "good_lost": scattered(n * rows["good"].to_numpy(np.int64))[:, :steps], "toxic_lost": scattered(n * rows["toxic"].to_numpy(np.int64))[:, :steps], "shapley": shapley[letter],
        }
        out = pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(ORDERS, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), orders)})
        return out.assign(**{c: columns[c].ravel() for c in COUNTS})

    return counts.groupBy("part").applyInPandas(run, kind)  # at most 128 rows a group


def op12_filter_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audited(written(mask_counts(written(signs(docs, labels), "signs")), "masks"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), m AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), r AS (
  SELECT part, fails, good, toxic, n, filter_order, coalesce(list_min([strpos(filter_order, y) FOR y IN string_split(fails, '') IF y <> '']), 6) AS leaves FROM m CROSS JOIN o
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, coalesce(sum(n) FILTER (leaves > step), 0) AS kept, coalesce(sum(n) FILTER (leaves = step), 0) AS removed,
    coalesce(sum(n) FILTER (leaves < step AND contains(fails, substr(filter_order, step, 1))), 0) AS redundant, coalesce(sum(n) FILTER (fails = substr(filter_order, step, 1)), 0) AS unique_fails,
    coalesce(sum(n) FILTER (leaves = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (leaves = step AND toxic), 0) AS toxic_lost
  FROM r CROSS JOIN (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s
"""
