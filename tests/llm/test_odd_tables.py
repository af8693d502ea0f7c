"""Empty tables, repeated rows, clashing names, and what is found and left alone among planted cases."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import exact_dedup, language_id, near_dedup, ogg, packing, pieces, pii, quality, token_counts, url_filter

CLASH = ("id", "text_sha256", "kept", "lang_pred", "lang_score", "bits_per_byte", "judged", "pii_base", "pii_spans", "base", "names", "candidates", "x", "score", "media", "bytes", "payload", "feature", "n_bytes", "n_tokens", "ids", "host", "path", "rule", "verdict", "block_score", "__host", "key", "n", "whole", "keys", "row", "norm")


def run_all(docs, labels):
    import public_tokenizers as P

    model = language_id.train(docs, F.lit(True))
    media = ogg.media_column(docs)
    described = quality.described(docs)
    return {
        "op1": url_filter.judge(docs, url_col="text"), "op2": pieces.digests(docs, P.path("piece_bpe_32k.model")), "op3": packing.pack(docs, ids_col="text", ids_of=token_counts.LibraryIds.public()), "op4": language_id.predictions(docs, model),
        "op5": token_counts.token_counts(docs, P.path("byte_bpe_50k.json")), "op6": quality.scored(described, quality.train(described, labels, F.lit(True))), "op7": pii.found(docs), "op8": exact_dedup.content_sort(docs), "op9": near_dedup.near_duplicates(docs), "op10": ogg.read_column(media),
    }


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for name, out in run_all(docs, labels).items():
        assert out.count() == 0, name


@pytest.fixture(scope="module")
def clashing(spark):
    """What the operators give for some rows, and for the same rows with columns of names that operators use."""
    rows = [(i % 5, ["the same text here of words", "ein Satz und noch einer", None, "", "token = \"0123456789abcdef0123\""][i % 5], ["en", "de", None, "en", "en"][i % 5]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int")
    return run_all(docs, labels), run_all(docs.withColumns({c: F.lit(7) for c in CLASH}), labels.withColumn("id", F.lit(1)))


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_repeated_rows_and_clashing_names(clashing, name):
    plain, more = (x[name] for x in clashing)
    # What the operator gives is the same; of the columns that the input has too, its own stay.
    names = [c for c in plain.columns if name != "op3" or c in ("size", "used", "ids")]
    assert sorted(map(str, plain.select(*names).collect())) == sorted(map(str, more.select(*names).collect()))
    if name != "op3":
        assert plain.count() == 10


def test_columns_named_as_those_of_the_url_filter(spark):
    pages = spark.createDataFrame([("http://A.org/x",)], "url string").withColumns({"Host": F.lit("mine"), "of_host": F.lit("kept"), "__host": F.lit("too"), "its_rule": F.lit(1), "its_score": F.lit(2)})
    r = url_filter.judge(pages).first().asDict()
    assert r == r | {"host": "a.org", "path": "/x", "of_host": "kept", "__host": "too", "its_rule": 1, "its_score": 2, "rule": "org/"} and "Host" not in r


def plain_statistics(text):
    raw = text.encode()
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    lines = [x for x in text.split("\n") if x]
    flat = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in lines]
    sets = [string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), b"0123456789", b".,;:", b"!?", b"|", b"%&$*#@^~<>{}[]=+\\/_", b" \t\n\r\x0b\x0c"]
    kinds = [sum(b in s for b in raw) for s in sets]
    beyond = sum(b > 127 for b in raw)
    kinds += [len(raw) - sum(kinds) - beyond, beyond]
    n, w, k = len(raw), len(words), len(lines)
    return [np.log1p(n), np.log1p(w), np.log1p((n - kinds[7]) / max(w, 1)), np.sqrt(len(set(low)) / max(w, 1)), np.sqrt(len(set(flat)) / max(k, 1)), np.log1p(n / max(k, 1)), *[np.sqrt(x / max(n, 1)) for x in kinds]]


def test_quality_statistics_are_the_plain_ones(spark):
    rng = random.Random(5)
    texts = ["", " ", "\n\n", "One two ONE\nTwo|x!? 12%\nTwo|x!? 12%", "ü é\tß\x0b日本 (a) \"b\" 'c'", "x" * 3000, *["".join(rng.choice("aB3 .\n|!é@-") for _ in range(rng.randint(1, 300))) for _ in range(40)]]
    got = {r.id: r.x for r in quality.described(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(t)), t


@pytest.fixture(scope="module")
def planted():
    """Texts with secrets and names, the values; and clean ones, with much that looks like them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice((20, 32, 40)))) + "7a"
    forms = [lambda: ('api_key = "{}"', key()), lambda: ("token: {}", key()), lambda: ("password: {}", word() + word() + "xyz"), lambda: ('passphrase = "{}"', f"{word()}-{word()}-{word()}z"), lambda: ('the secret is "{}"', word() + word() + "qq"), lambda: ("account 4{}", None), lambda: ("met {} there", "Alice Johnson"), lambda: ("login: {}", word() + word() + "k")]
    dirty = []
    for i in range(240):
        form, value = forms[i % len(forms)]()
        value = value or "".join(rng.choice("0123456789") for _ in range(9))
        shown = form.format(value) if "{}" in form else form
        dirty.append((f"{prose(rng.randint(3, 20))} {shown} {prose(rng.randint(3, 20))}", "4" + value if form.startswith("account") else value))
    decoys = ["section 12 of", "version 3.14.1", "in 1998 and 2004", "page 7, line 33", "chapter 9", "note: something", "cost 1,250.50 euros", "the 3rd and 4th", "at 12:30 on 2021-05-17", "figure 8 shows", "see https://plain.example.org/about", "weighs 70kg", "number 4929411182003156 of", "number 1234567890123456789012", "login is required here", "Alice in Wonderland", "the Peter principle", "so Karen went", "the token is lost"]
    clean = [f"{prose(rng.randint(3, 20))} {decoys[i % len(decoys)]} {prose(rng.randint(3, 20))}" for i in range(19 * 20)]
    return dirty, clean


def test_planted_secrets_are_found_and_clean_texts_left(spark, planted):
    dirty, clean = planted
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in dirty] + clean)], "doc_id int, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.pii_spans if s.kind == "secret"] for r in pii.found(docs).collect()}
    hit = [any(t[a:b] == v or v in t[a:b] for a, b in got[i]) for i, (t, v) in enumerate(dirty)]
    false = sum(len(got[len(dirty) + i]) > 0 for i in range(len(clean)))
    extra = sum(not (v in t[a:b] or t[a:b] in v) for i, (t, v) in enumerate(dirty) for a, b in got[i])
    recall, precision = np.mean(hit), sum(hit) / (sum(hit) + false + extra)
    by_form = [round(float(np.mean(hit[k::8])), 2) for k in range(8)]
    assert recall >= 0.8 and precision >= 0.95, (recall, precision, by_form, [clean[i] for i in range(len(clean)) if got[len(dirty) + i]][:5])


def plain_candidates(text):
    """Tokens with a digit, as (start, end) of what would be the span, by walking over the text."""
    out = []
    for m in re.finditer(r"\S+", text):
        t = m.group()
        if not re.search("[0-9]", t):
            continue
        end = m.end() - len(re.search(r"[^A-Za-z0-9]*$", t).group())
        core = re.search(r"([A-Za-z0-9][A-Za-z0-9_./+-]*)$", t[: end - m.start()])
        out.append((end - len(core.group()) if core else end, end))
    return out


def test_candidates_with_digits_are_the_plain_ones(spark):
    rng = random.Random(4)
    texts = ["", "a1", "é12 🙂 x9y", *["".join(rng.choice("ab1 2=:\"'.-é\n") for _ in range(rng.randint(1, 60))) for _ in range(150)], " ".join(f"v{i}" for i in range(3000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = docs.select("doc_id", pii.with_digits(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()
    for r in got:
        assert [(c.start, c.end) for c in r.c] == plain_candidates(texts[r.doc_id]), texts[r.doc_id]
