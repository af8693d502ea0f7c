"""Language ID by prediction by partial matching.

For each language the bytes of its training texts give a context tree: how often each byte follows each context of up
to `order` bytes. A byte's code length under a context is -log2 of its share there or, if it never followed there, the
escape's code length plus that of the next shorter context, down to all 256 bytes alike (escape method C: a context
with n symbols of d kinds gives a kind seen c times c/(n+d) and the escape d/(n+d)). Statistics are frozen, so code
lengths of all contexts and bytes are worked out once, in units of 2**-16 bit; a text's length in a language is the
sum over all its bytes. Contexts of all languages share one tree, whose state after a byte is the longest context
known. The shortest code wins; score is its probability among the languages, all alike before.

Training rows are chosen by a hash of their id, about per_language for each language and most_bytes of text (documented
bounds of this operator's model; everything else covers all rows). Their counts are summed by Spark.

Cases: a null text, or one without a letter, is `und` with score 0. A null language is not learnt from; if there is
nothing to learn from, all is `und`. Equal lengths go to the first language by name. Repeated rows give repeated rows,
an empty table none. Other columns are not looked at.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, fresh, own_columns, short_batches, table, utf8

UNIT = 1 << 16
#: languages; symbol: class of each byte; goto: state after a symbol; cost: code length (state, symbol, language). The last symbol stands before a text.
Model = namedtuple("Model", "languages symbol goto cost order")


def grams(data: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Each run of n bytes inside a text, as one number."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(data) - n + 1, np.int64)
    for j in range(n):
        out = out << 8 | data[j : len(data) - n + 1 + j]
    left = np.repeat(ends[1:], np.diff(ends))[: len(out)] - np.arange(len(out))
    return out[left >= n]


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, n, gram, count over the texts of docs (lang, text); lang is a number or a name."""

    def run(batches):
        for b in blocks(batches, "text"):
            data, ends = utf8(b.column("text"))
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            for lang in np.unique(langs):
                rows = np.flatnonzero(langs == lang)
                own = np.concatenate([data[ends[i] : ends[i + 1]] for i in rows])
                own_ends = np.concatenate(([0], np.cumsum(np.diff(ends)[rows])))
                for n in range(1, order + 2):
                    gram, count = np.unique(grams(own, own_ends, n), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), b.column("lang").type), "n": pa.array(np.full(len(gram), n), pa.int32()), "gram": gram, "count": count})

    counts = short_batches(docs).mapInArrow(run, f"lang {docs.schema['lang'].dataType.simpleString()}, n int, gram bigint, count bigint")
    return counts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def build(counts, order: int, languages: list[str]) -> Model:
    """counts: arrays or columns lang (a place in languages), n, gram, count. languages: by name."""
    which, n, gram, count = (np.asarray(counts[c]) for c in ("lang", "n", "gram", "count"))
    seen = np.unique(gram[n == 1])
    symbols = len(seen) + 2  # one for all other bytes, one for the place before a text
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    contexts = [np.unique(gram[n == d + 1] >> 8) if d else np.zeros(1, np.int64) for d in range(order + 1)]
    base = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    goto = np.zeros((base[-1], symbols), np.int32)
    cost = np.zeros((base[-1], symbols, len(languages)), np.float64)
    for d, own in enumerate(contexts):
        rows = slice(base[d], base[d + 1])
        if d:
            shorter = base[d - 1] + np.searchsorted(contexts[d - 1], own & ((1 << 8 * (d - 1)) - 1))
        if d < order and len(contexts[d + 1]):
            longer = (own[:, None] << 8) | seen[None, :]
            at = np.minimum(np.searchsorted(contexts[d + 1], longer), len(contexts[d + 1]) - 1)
            found = contexts[d + 1][at] == longer
            goto[rows, : len(seen)] = np.where(found, base[d + 1] + at, goto[shorter, : len(seen)] if d else 0)
        elif d:
            goto[rows] = goto[shorter]
        for k in range(len(languages)):
            mine = (n == d + 1) & (which == k)
            c = np.zeros((len(own), symbols))
            np.add.at(c, (np.searchsorted(own, gram[mine] >> 8), symbol[gram[mine] & 255]), count[mine])
            total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            less = cost[shorter, :, k] if d else np.full((1, symbols), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                own_cost = np.where(c > 0, -np.log2(c / (total + kinds)), np.log2((total + kinds) / kinds) + less)
            cost[rows, :, k] = np.where(total > 0, own_cost, less)
    goto[:, -1], cost[:, -1] = 0, 0
    return Model(languages, symbol, goto, np.rint(cost * UNIT).astype(np.int32), order)


def code_lengths(model: Model, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units of code length of each text (rows) in each language (columns)."""
    order, n = model.order, len(ends) - 1
    starts = ends[:-1] + order * np.arange(1, n + 1)
    padded = np.full(len(data) + order * n, model.goto.shape[1] - 1, np.int32)
    place = np.arange(len(data)) + np.repeat(order * np.arange(1, n + 1), np.diff(ends))
    padded[place] = model.symbol[data]
    state = np.zeros(len(data), np.int32)
    for back in range(order, 0, -1):
        state = model.goto[state, padded[place - back]]
    per_byte = model.cost[state, padded[place]]
    sums = np.zeros((n, len(model.languages)), np.int64)
    full = np.diff(ends) > 0
    if full.any():
        sums[full] = np.add.reduceat(per_byte, (starts - order * np.arange(1, n + 1))[full], axis=0, dtype=np.int64)
    return sums


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, mod by; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, per_language: int = 400, most_bytes: int = 4 << 20) -> Model:
    """Learns from about per_language of the rows of each language where `learn` holds, or fewer where these have more than about most_bytes."""
    ok = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = ok.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint")).alias("bytes")).collect()
    sizes = {r.lang: min(per_language / r.n, most_bytes / max(1, r.bytes)) for r in sums}
    languages = sorted(sizes)
    if not sizes:
        return build({"lang": np.zeros(0, int), "n": np.zeros(0, int), "gram": np.zeros(0, np.int64), "count": np.zeros(0, int)}, order, languages)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, part in sizes.items() for x in (lang, part)]), F.col(lang_col))
    number = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / (1 << 20)
    sample = ok.where(draw < share).select(number.alias("lang"), F.col(text_col).alias("text"))
    counts = gram_counts(sample, order).toArrow()
    model = build({c: counts.column(c).to_numpy() for c in counts.column_names}, order, languages)
    del counts
    pa.default_memory_pool().release_unused()  # the driver keeps none of the counts
    return model


def judged(model: Model, spark: SparkSession, text: Column) -> Column:
    """struct (lang, score, bits) of a text: the language, its probability and its code's bits for each byte.

    Only the text goes to Python and only the struct comes back; the other columns stay on the JVM's side.
    """
    held = spark.sparkContext.broadcast(model)
    short_batches(spark.range(0))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for t in texts:
            lang, score, bits = [], [], []
            for b in blocks([pa.RecordBatch.from_arrays([t], ["text"])], "text"):
                data, ends = utf8(b.column("text"))
                n = len(ends) - 1
                if m.languages:
                    lengths = code_lengths(m, data, ends)
                    best = lengths.argmin(axis=1)
                    low = lengths[np.arange(n), best]
                    score.append(1 / np.exp2((low[:, None] - lengths) / UNIT).sum(axis=1))
                    lang += [m.languages[i] for i in best]
                    bits.append(low / UNIT / np.maximum(1, np.diff(ends)))
                else:
                    score.append(np.zeros(n))
                    lang += [None] * n
                    bits.append(np.full(n, 8.0))
            parts = [pa.array(lang, pa.string()), *[pa.array(np.concatenate(x) if x else np.zeros(0)) for x in (score, bits)]]
            yield pa.StructArray.from_arrays(parts, ["lang", "score", "bits"])

    # Not deterministic for the planner: else a filter on the result is put below and has it worked out twice.
    code = F.arrow_udf(run, "lang string, score double, bits double").asNondeterministic()
    return code(F.coalesce(text, F.lit("")))


def predictions(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and bits_per_byte of each row behind its columns; columns that have these names already give way."""
    text, one = F.col(text_col).cast("string"), fresh(docs, "judged")
    out = docs.withColumn(one, judged(model, docs.sparkSession, text))
    # Whether there is a letter is seen on the JVM's side; the search ends at the first.
    none = F.col(one)["lang"].isNull() | ~F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return out.select(
        *own_columns(docs, ("lang_pred", "lang_score", "bits_per_byte")), F.when(none, "und").otherwise(F.col(one)["lang"]).alias("lang_pred"),
        F.when(none, 0.0).otherwise(F.col(one)["score"]).alias("lang_score"), F.col(one)["bits"].alias("bits_per_byte"),
    )


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, remainder("doc_id", 3) != 1)
    out = predictions(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")
