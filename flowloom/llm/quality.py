"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text gives STATISTICS: sizes as logarithms, shares of character classes, words and lines as square roots. The two
classes' means and covariances come from sums that Spark adds up over all labelled rows; each covariance is shrunk
towards the pooled one and that towards its mean variance. A score is the chance of class 1 by the difference of the
log densities (Mahalanobis distances by the Cholesky factors, worked out once) and the classes' shares.

Cases: a null text is empty; its statistics are 0 and it gets a score as any other. Labels other than 0 and 1 and null
labels are left out; several labels of one id count as their mean, 0.5 or more as 1. With fewer than two rows of a
class all scores are the share of class 1 (0.5 without labels). Repeated rows give repeated rows, an empty table none.
Other columns are not looked at.
"""

from __future__ import annotations

from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, short_batches, table, utf8, written
from flowloom.llm.language_id import remainder
from flowloom.llm.near_dedup import word_hashes

STATISTICS = ("bytes", "words", "word_length", "distinct_words", "distinct_lines", "line_length", "upper", "lower", "digits", "stops", "shouts", "bars", "signs", "spaces", "other", "beyond_ascii")
#: Classes of bytes: upper, lower, digits, stops, shouts, bars, signs, spaces, other, beyond ASCII.
_KIND = np.full(256, 8, np.uint8)
for _chars, _k in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), (b".,;:", 3), (b"!?", 4), (b"|", 5), (b"%&$*#@^~<>{}[]=+\\/_", 6), (b" \t\n\r\x0b\x0c", 7), (range(128, 256), 9)):
    _KIND[list(_chars)] = _k
#: Statistics are below 32 and products of theirs below 2**50 in these units, so 64 bits hold the sums of CHUNK rows.
GRID, CHUNK = 1 << 20, 4096
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
#: factor: inverse Cholesky factors; const: log share minus half the log determinant, for the two classes.
Model = namedtuple("Model", "mean factor const share")


def distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], float)


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = np.diff(ends).astype(float)
    rows = len(n)
    kinds = np.bincount(np.repeat(np.arange(rows) * 10, np.diff(ends)) + _KIND[data], minlength=rows * 10).reshape(rows, 10)
    words, at = word_hashes(data, ends)
    lines, line_at = word_hashes(data, ends, _BREAK)
    w, l = np.diff(at).astype(float), np.diff(line_at).astype(float)
    one = np.maximum(n, 1)
    shares = np.sqrt(kinds / one[:, None])
    return np.column_stack([
        np.log1p(n), np.log1p(w), np.log1p((n - kinds[:, 7]) / np.maximum(w, 1)), np.sqrt(distinct(words, at) / np.maximum(w, 1)), np.sqrt(distinct(lines, line_at) / np.maximum(l, 1)), np.log1p(n / np.maximum(l, 1)), shares,
    ])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the statistics of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(statistics(*utf8(b.column("text")))), pa.list_(pa.float64()))], ["id", "x"])

    return short_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class of rows (label, x): number, sum and sum of products.

    Statistics become whole numbers of 1/GRID, so sums are exact and the same in any order: 64 bits hold those of
    CHUNK rows, decimals the rest.
    """
    p = len(STATISTICS)

    def run(batches):
        for b in batches:
            x = np.rint(np.array(b.column("x").to_pylist(), float).reshape(-1, p) * GRID).astype(np.int64)
            y = np.array(b.column("label").to_pylist(), int)
            for at in range(0, len(x), CHUNK):
                each = [x[at : at + CHUNK][y[at : at + CHUNK] == k] for k in (0, 1)]
                total = [np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel())) for own in each]
                yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "s": pa.array(total, pa.list_(pa.int64()))})

    parts = rows.select("label", "x").mapInArrow(run, "label int, s array<bigint>")
    whole = parts.select("label", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros((2, 1 + p + p * p))
    for r in whole:
        out[r.label, r.i] = int(r.v) / (1 if r.i == 0 else GRID if r.i <= p else GRID * GRID)
    return {k: (out[k, 0], out[k, 1 : 1 + p], out[k, 1 + p :].reshape(p, p)) for k in (0, 1)}


def fit(by_class: dict, pull: float = 0.1, round_off: float = 0.01) -> Model:
    """pull: share of the pooled covariance in each class's. round_off: share of the mean variance in both."""
    p, n = len(STATISTICS), [by_class[k][0] for k in (0, 1)]
    share = n[1] / sum(n) if sum(n) else 0.5
    if min(n) < 2:
        return Model(None, None, None, share)
    mean = [by_class[k][1] / n[k] for k in (0, 1)]
    scatter = [by_class[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / sum(n)
    factor, const = [], []
    for k in (0, 1):
        cov = (1 - pull) * scatter[k] / n[k] + pull * pooled
        cov = (1 - round_off) * cov + round_off * (np.trace(pooled) / p + 1e-9) * np.eye(p)
        low = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(low))
        const.append(np.log(n[k] / sum(n)) - np.log(np.diag(low)).sum())
    return Model(mean, factor, const, share)


def chances(model: Model, x: np.ndarray) -> np.ndarray:
    if model.mean is None:
        return np.full(len(x), model.share)
    def distance(k: int) -> np.ndarray:
        """Element by element, in one order: a text's score doesn't depend on the batch that it is in."""
        out = np.zeros(len(x))
        for row in model.factor[k]:
            z = np.zeros(len(x))
            for j, w in enumerate(row):
                z += w * (x[:, j] - model.mean[k][j])
            out += z * z
        return out

    log = [model.const[k] - 0.5 * distance(k) for k in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def train(rows: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """rows: what described() gives. labels: id and label; `learn` says which of them may be used."""
    known = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.when(F.avg(label_col) >= 0.5, 1).otherwise(0).alias("label"))
    return fit(sums(rows.join(known, "id")))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """id and score of the rows that described() gives."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(chances(held.value, x))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op6_quality_classifier(spark, sf_dir):
    rows = written(described(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    model = train(rows, table(spark, sf_dir, "labels").select("doc_id", "quality"), remainder("doc_id", 5) != 0)
    out = scored(rows, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
