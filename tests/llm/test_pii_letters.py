"""Secrets without a digit and names are candidates and are masked; plain words beside them are not."""

from pyspark.sql import functions as F

from flowloom.llm import pii


def test_letters_are_voted_on(spark):
    want = {
        "my password: correcthorse and more": "my password: [SECRET] and more", 'passphrase = "open-sesame-kingdom"': 'passphrase = "[SECRET]"', "password=correcthorse": "password=[SECRET]",
        "password1: correcthorse": None, "login: bobbysmith today": "login: [SECRET] today", "passphrase: señorbátery, ok": "passphrase: [SECRET], ok", "we met Alice Johnson, then Mary.": "we met [SECRET], then Mary.", "a login is required": "a login is required", "Alice in Wonderland": "Alice in Wonderland", "Dr. Fernandez said so": "Dr. [SECRET] said so",
        "Note: something else here": "Note: something else here", "http://plain.example.org/about": "http://plain.example.org/about", "key: value pairs": "key: value pairs", "nothing at all": "nothing at all",
    }
    hexes = [f'token = "{i:08x}4e3e49cf46b2d7c90f3602a3d0b907ff"' for i in range(60)] + [f"section {i} of the act" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*want, *hexes])), "doc_id int, text string")
    got = {r.text: r.masked for r in pii.found(docs).withColumn("masked", pii.masked(F.col("text"), F.col("pii_spans"))).collect()}
    assert {t: got[t] for t, m in want.items() if m} == {t: m for t, m in want.items() if m}
    assert got["password1: correcthorse"].endswith(": [SECRET]")
    assert got[hexes[0]] == 'token = "[SECRET]"' and got[hexes[-1]] == hexes[-1]
