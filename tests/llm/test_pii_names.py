"""Names come through the votes of labelers: those of a list, those of none, and words in capitals that are no person's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import pii

LISTED = ["Alice Johnson", "Jürgen Köhler", "María Ortega", "Thomas O'Brien", "Pierre Lefèvre", "Anna de Vries", "Sarah Whitcombe", "Mohammed Rahal"]
UNLISTED = ["Siobhan Murphy", "Ikechukwu Obi", "Saoirse Kavanagh", "Torvald Lindqvist", "Priya Raghunathan", "Anneliese Vogt", "Zdeněk Malý", "Xiomara Quispe"]
PERSONS = ["{} called", "we met {} there", "it was written by {} and others", "yesterday {} said so", "asked Dr. {} about it", "write to Mrs {} now", "signed, {}.", "und {} sagte nichts"]
NONE = [
    "Alice in Wonderland", "the Peter principle", "The Peter principle", "so Karen went", "under the General Public License", "Charles University is old", "in Alice Springs now", "The The The The", "Der Der Der", "from New York", "the Royal Society wrote", "a Blue Danube waltz",
    "using Visual Basic daily", "by the Green Lantern", "of Great Expectations", "in Northern Ireland", "Total Quality Management is", "Apache License", "on Market Street", "login is required",
]


@pytest.fixture(scope="module")
def spans(spark):
    """For each text its name, if any, and what was added."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(f"{prose(8)}. {form.format(name)} {prose(6)}", name) for form in PERSONS for name in LISTED + UNLISTED]
    rows += [(f"{prose(8)} {d} {prose(6)}", None) for d in NONE for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.pii_spans] for r in pii.found(docs).collect()}
    return [(t, name, got[i]) for i, (t, name) in enumerate(rows)]


@pytest.mark.parametrize("names", [LISTED, UNLISTED])
def test_names_are_found(spans, names):
    hit = [(name in got, t) for t, name, got in spans if name in names]
    assert np.mean([h for h, _ in hit]) >= 0.9, [t for h, t in hit if not h]


def test_other_capitals_are_left(spans):
    wrong = {t: got for t, name, got in spans if got and got != [name]}
    assert len(wrong) <= 0.02 * len(spans), wrong


def test_votes_differ(spark):
    texts = ["we met Alice Johnson there", "Alice Springs", "The Green Lantern of old", "see Mr. Obi", "so Big Bang Theory"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.explode(pii.with_names(F.col("text"), pii.base_spans(F.col("text")))).alias("c")).collect()
    votes = {texts[r.i]: tuple(r.c[f] for f in pii.NAME_LABELERS) for r in rows}
    assert len(votes) == len(texts) == len(set(votes.values()))
    assert votes[texts[0]] == (1, 0, 1, 0, 1, 1, 0) and votes[texts[1]][0] == -1 and votes[texts[3]][1] == 1


def test_a_corpus_without_names_gets_none(spark):
    docs = spark.createDataFrame([(i, f"{a} {b} ndtion the {a} {b} re") for i, (a, b) in enumerate((x, y) for x in ("Thre", "Onndble", "Einü", "The") for y in ("Rech", "Mente", "Der"))], "doc_id int, text string")
    assert all(r.n == 0 for r in pii.found(docs).select(F.size("pii_spans").alias("n")).collect())


def test_names_beside_names_and_long_runs(spark):
    texts = ["Alice Johnson and Peter Miller, Anna Berg", "Of " * 3000, "Mr. " * 500, "A. B. C", "É", "met Mary-Jane O'Hara\nthe end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: [r.text[c.start : c.end] for c in r.c] for r in docs.withColumn("c", pii.with_names(F.col("text"), pii.base_spans(F.col("text")))).collect()}
    assert got[0] == ["Alice Johnson", "Peter Miller", "Anna Berg"] and got[5] == ["Mary-Jane O'Hara"] and got[3] == got[4] == got[2] == [] and len(got[1]) == 1000
