"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text's lines are cut into paragraphs of at most 256 code points, at sentence ends where there are any; each distinct
one has a 64-bit digest. A sketch has three parts of cells; a digest goes into one cell of each part, and a cell holds
how many digests it has, and the exclusive or of them and of their check values. Two sketches are subtracted cell by
cell: what both texts share goes, whatever their sizes. Peeling takes the digests of cells that hold just one, out of
their other cells too, again and again, until none is left: these are the digests that either text has alone. Where
cells remain, the sketch was too small for the difference: the pair is tried again with four times as many cells and
other places, until nothing is left.

Likeness of two texts is the share of the digests of either that both have, from the digests peeled and the sizes in
the fingerprints; two texts without digests have 1. A fingerprint is the number of digests and the cells of the first,
fixed size that hold something. Cells are rows; all of a document's lie in one bucket, so subtracting and peeling are
groupings without a shuffle.

Each document meets the next one by id in ranges with one row of overlap: sampled splitters deal the rows out, each is
also sent to the range before if it begins one, and windows look one row ahead. Texts are shuffled once, and only their
digests go on.

Cases: a null text is empty and has no digests. Texts are never cut short. A null id comes after all others; rows of one
id are ordered by a hash of the text. A single document is its own next one. Repeated rows give repeated rows, an empty
table none. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import bucketed, table, written

#: Places in each of the three parts of a fingerprint's sketch, and how many times as many a retry has.
PART, LARGER = 48, 4
PARAGRAPH = r"[^\n]{1,128}+[^.!?\n]{0,128}+[.!?\n]*+|\n++"
#: Where the digests go that peeling has found: those of the left side alone, and of the right.
LEFT, RIGHT = -1, -2


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.hash(digest, F.lit("check"))


def place(digest: Column, j: int, part: int, level: int) -> Column:
    """The cell of part j that a digest goes into; part: places in each."""
    return (F.pmod(F.xxhash64(digest, F.lit(3 * level + j)), F.lit(part)) + part * j).cast("int")


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the same place put together; empty ones go. rows: keys, cell, own, count, digest, check."""
    sums = rows.groupBy(*keys, "cell", "own").agg(F.sum("count").alias("count"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
    return sums.where("count <> 0 OR digest <> 0 OR check <> 0")


def cells(rows: DataFrame, keys: list[str], part: int = PART, level: int = 0) -> DataFrame:
    """The sketches of rows(keys, digest, sign): keys, cell, own, count, digest, check. Signs of both kinds subtract."""
    rows = rows.withColumn("check", check(F.col("digest"))).withColumn("cell", F.explode(F.array(*[place(F.col("digest"), j, part, level) for j in range(3)])))
    return together(rows.select(*keys, "cell", F.lit(0).cast("bigint").alias("own"), F.col("sign").cast("bigint").alias("count"), "digest", "check"), keys)


def peeled(sketches: DataFrame, keys: list[str], part: int = PART, level: int = 0, rounds: int = 6, listed: bool = True, at_once: int = 2) -> DataFrame:
    """Subtracted sketches with what is found moved to the cells LEFT and RIGHT (own: the digest, if listed) and taken out of all others.

    A step peels one part, where a digest has one cell only, so it is taken out once; a round has three steps. Cells of
    one sketch meet in groupings alone, so sketches that lie together by their keys are peeled without a shuffle. After
    at_once rounds what is left is written, and it ends if that is nothing: each grouping in a plan holds memory.
    """
    for step in range(3 * rounds):
        if step and step % (3 * at_once) == 0:
            sketches = written(sketches, "cells")
            if not sketches.where("cell >= 0").limit(1).count():
                break
        j = step % 3
        single = F.col("cell").between(j * part, (j + 1) * part - 1) & (F.abs("count") == 1) & (F.col("check") == check(F.col("digest")))

        def cell(where: Column, own: Column, n: Column, digest: Column, mark: Column) -> Column:
            return F.struct(where.cast("int").alias("cell"), own.cast("bigint").alias("own"), n.cast("bigint").alias("count"), digest.cast("bigint").alias("digest"), mark.cast("int").alias("check"))

        none = F.lit(0)
        found = cell(F.when(F.col("count") == 1, LEFT).otherwise(RIGHT), F.col("digest") if listed else none, F.lit(1), none, none)
        gone = [cell(place(F.col("digest"), i, part, level), none, -F.col("count"), F.col("digest"), F.col("check")) for i in range(3) if i != j]
        stays = cell(*(F.col(c) for c in ("cell", "own", "count", "digest", "check")))
        rows = sketches.select(*keys, F.explode(F.when(single, F.array(found, *gone)).otherwise(F.array(stays))).alias("c"))
        sketches = together(rows.select(*keys, "c.*"), keys)
    return sketches


def signed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest, sign of both sides of pairs(keys, left, right)."""

    def with_sign(side: str, sign: int) -> Column:
        return F.transform(side, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))

    both = F.concat(with_sign("left", 1), with_sign("right", -1))
    return pairs.select(*keys, F.explode(both).alias("d")).select(*keys, "d.*")


def attempts(pairs: DataFrame, keys: list[str], listed: bool) -> list[DataFrame]:
    """Cells LEFT and RIGHT of the pairs whose sketches peel wholly, one table for each size of sketch."""
    out, todo, part, level = [], pairs, PART, 0
    while True:
        left_over = peeled(cells(signed(todo, keys), keys, part, level), keys, part, level, listed=listed)
        tried = written(left_over.groupBy(*keys).agg(*([F.collect_list(F.when(F.col("cell") == side, F.col("own"))).alias(n) for side, n in ((LEFT, "only_left"), (RIGHT, "only_right"))] if listed else [F.sum(F.when(F.col("cell") < 0, F.col("count"))).alias("apart")]), F.count_if(F.col("cell") >= 0).alias("left_over")), "peeled")
        out.append(tried.where("left_over = 0").drop("left_over"))
        if not tried.where("left_over > 0").limit(1).count():
            return out
        todo, part, level = pairs.join(tried.where("left_over > 0").select(*keys), keys, "left_semi"), part * LARGER, level + 1


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, only_left, only_right: the digests that one side alone has, for the pairs that differ. pairs: keys, which tell them apart, and left and right (arrays of distinct digests)."""
    return reduce(DataFrame.unionByName, attempts(pairs, keys, True))


def distances(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, apart: how many digests one side alone has, for the pairs that differ."""
    return reduce(DataFrame.unionByName, attempts(pairs, keys, False))


def fingerprints(rows: DataFrame, keys: list[str], digests_col: str) -> DataFrame:
    """keys and fingerprint of the rows that have digests: 15 bytes for each cell that holds something (place, count, digest, check), by place, as base64."""
    held = cells(rows.select(*keys, F.explode(digests_col).alias("digest"), F.lit(1).alias("sign")), keys)
    one = F.concat(*[F.lpad(F.hex(F.col(c).cast("bigint")), n, "0") for c, n in (("cell", 2), ("count", 4), ("digest", 16))], F.lpad(F.right(F.hex(F.col("check").cast("bigint")), F.lit(8)), 8, "0"))
    return held.groupBy(*keys).agg(F.replace(F.base64(F.unhex(F.array_join(F.sort_array(F.collect_list(one)), ""))), F.lit("\r\n"), F.lit("")).alias("cells"))


def likeness(left: Column, right: Column, apart: Column) -> Column:
    """Of the sizes of two sets and the number of members that one alone has."""
    return F.when(left + right == 0, F.lit(1.0)).otherwise((left + right - apart) / (left + right + apart))


def with_next(rows: DataFrame, buckets: int | None = None, per_bucket: int = 32) -> DataFrame:
    """rows(no_id, id, tie, ...) with next, the struct of the row after it by (no_id, id, tie); after the last comes the first."""
    order = ["no_id", "id", "tie"]
    size = rows.count()
    buckets = buckets or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, buckets * per_bucket / max(1, size))
    sample = rows.select(*order).where(F.pmod(F.xxhash64("id", "tie", F.lit("cuts")), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    step = max(1, int(size * share) // buckets)
    ranked = sample.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # a bounded sample
    first = rows.select(*order).orderBy(*order).limit(1).collect()
    if not first:
        return rows.withColumn("next", F.struct(*rows.columns))
    # The first row begins the first range, and a range begins with a row that there is.
    cuts = [tuple(first[0]), *[tuple(r)[:3] for r in ranked.where(F.col("n") % step == 0).orderBy("n").limit(buckets - 1).collect()]]
    cuts = [c for i, c in enumerate(cuts) if c != cuts[0] or i == 0]
    kinds = [rows.schema[c].dataType.simpleString() for c in order]
    begins = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(c, kinds, order, strict=True)]) for c in cuts])
    own = F.struct(*order)

    def after(key: Column) -> Column:
        """How many cuts are at or before the key, by a search over powers of two. Null ids compare as equal, below all others; no_id comes first."""
        def one(at: Column, width: Column) -> Column:
            return F.when(F.coalesce(F.get(begins, at + width - 1) <= key, F.lit(False)), at + width).otherwise(at)

        return F.aggregate(F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))]), F.lit(0), one)

    placed = rows.withColumn("bucket", after(own) - 1)
    starts = F.get(begins, F.col("bucket")) == own
    both = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ahead")), F.when(starts, F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(cuts))).alias("bucket"), F.lit(1).alias("ahead")))))
    dealt = placed.withColumn("to", F.explode(both)).drop("bucket").select("*", "to.bucket", "to.ahead").drop("to").repartition(buckets, "bucket")
    look = Window.partitionBy("bucket").orderBy("ahead", *order)
    out = dealt.withColumn("next", F.lead(F.struct(*rows.columns)).over(look))
    return out.where("ahead = 0").drop("bucket", "ahead")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows.withColumn("keys", digests(F.col("text"))))
    n = F.char_length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4).cast("int")), F.left(F.col("next")["text"], F.floor(n / 4).cast("int")))
    held = rows.select("id", n.cast("bigint").alias("n_chars"), "keys", F.col("next")["keys"].alias("next_keys"), edited.alias("edited"))
    held = held.select(F.monotonically_increasing_id().alias("row"), "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys")
    held = bucketed(held, "row", "digests")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(k).alias("right")) for i, k in enumerate(("edited_keys", "next_keys"))]))
    apart = distances(held.select("row", F.col("keys").alias("left"), sides.alias("p")).select("row", "left", "p.*"), ["row", "which"])
    apart = apart.groupBy("row").agg(*[F.max(F.when(F.col("which") == i, F.col("apart"))).alias(f"apart{i}") for i in (0, 1)])
    marks = [fingerprints(held, ["row"], c).withColumnRenamed("cells", n) for c, n in (("keys", "cells"), ("edited_keys", "edited_cells"))]
    out = held.join(apart, "row", "left").join(marks[0], "row", "left").join(marks[1], "row", "left")

    def mark(keys: str, cells_col: str) -> Column:
        return F.concat(F.size(keys).cast("string"), F.lit(":"), F.coalesce(cells_col, F.lit("")))

    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", mark("keys", "cells").alias("fingerprint"), mark("edited_keys", "edited_cells").alias("edited_fingerprint"),
        likeness(F.size("keys"), F.size("edited_keys"), F.coalesce("apart0", F.lit(0))).alias("near_edited"), likeness(F.size("keys"), F.size("next_keys"), F.coalesce("apart1", F.lit(0))).alias("near_next"),
    )


def op11_document_fingerprints(spark, sf_dir):
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
