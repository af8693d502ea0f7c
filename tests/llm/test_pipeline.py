"""The pipeline's stages on a small corpus with odd rows, against what each should do."""

import random

import pytest


def corpus(tmp_path, spark):
    rng = random.Random(0)
    vocab = {"en": "the of and thing that with from this have been".split(), "de": "der die das und nicht mit auch eine werden über".split()}
    rows, n = [], 0
    for lang, v in vocab.items():
        for _ in range(40):
            rows.append((n, " ".join(rng.choice(v) + rng.choice("abcdefg") * rng.randint(0, 2) for _ in range(60)), lang, "s", 0))
            n += 1
    w = rows[3][1].split()
    w[30] = "changed"
    rows += [(n, rows[0][1] + " ", "en", "s", 0), (n + 1, " ".join(w), "en", "s", 0), (n + 2, None, None, None, None), (n + 3, "12 34 !!", "en", "s", 0), (n + 4, "write to me the thing that have@mail.example.com and this", "en", "s", 0), (None, "and of the thing with this that has no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return n


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    n = corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [x for x, _ in c.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    stages, columns = dict(c.STAGES), docs.columns
    kept = stages["language_id"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == set(range(n + 2)) | {n + 4, None}
    kept = stages["exact_dedup"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and 0 not in ids and n in ids and len(ids) == docs.count() - 1  # the longer text stays
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and {0, 3} <= ids and not ids & {n, n + 1} and None in ids
    out = {r.doc_id: r for r in stages["pii"](spark, docs, str(tmp_path)).collect()}
    assert out[n + 4].text == "write to me the thing that [EMAIL] and this" and out[n + 4].n_chars == len(out[n + 4].text)
    assert out[0].text == docs.where("doc_id = 0").first().text and out[n + 2].text is None


def test_run_and_empty(spark, tmp_path):
    import corpus_pipeline as c

    n = corpus(tmp_path, spark)
    rows = c.run(spark, str(tmp_path)).collect()
    assert {i for r in rows for i in r.doc_ids} == set(range(1, n)) | {n, n + 4, None}  # document 0's longer copy stays for it, the near copy of 3 goes
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("column", ["doc_id", "text", "lang", "source", "n_chars"])
def test_each_column_may_be_null(spark, tmp_path, column):
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(12)
    docs = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    for _, stage in c.STAGES:
        stage(spark, docs, str(tmp_path)).count()


def test_columns_with_clashing_names(spark, tmp_path):
    """Columns that are called like what the operators add stay as they are."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    n = corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = {name: sorted(map(str, stage(spark, docs, str(tmp_path)).collect())) for name, stage in c.STAGES[:-1]}
    odd = ("lang_pred", "lang_score", "bits_per_byte", "pii_base", "pii_spans", "text_sha256", "id", "judged", "the_text", "base", "names", "candidates", "row", "norm", "kept", "component_id", "whole", "keys", "ids", "a.b")
    more = docs.withColumns({x: F.lit(i) for i, x in enumerate(odd)})
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns
        rows = out.collect()
        assert all(list(r)[5:] == list(range(len(odd))) for r in rows)
        assert sorted(map(str, out.select(*docs.columns).collect())) == plain[name], name
    assert {i for r in c.STAGES[-1][1](spark, more, str(tmp_path)).collect() for i in r.doc_ids} >= set(range(n))


def test_masked_texts_have_their_length(spark):
    import os

    import corpus_pipeline as c

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = dict(c.STAGES)["pii"](spark, docs, "/root/testdata/sf0.01")
    assert out.where("n_chars <> char_length(text)").count() == 0 and out.where("contains(text, '[EMAIL]')").count() > 0


def test_without_any_language_all_with_a_letter_stay(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(("some words", "12 !!", None, "", "ein Wort"))], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in dict(c.STAGES)["language_id"](spark, docs, str(tmp_path)).collect()} == {0, 4}
