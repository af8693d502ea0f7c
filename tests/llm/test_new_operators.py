"""Operators 11 to 13 against plain versions, on hand-made rows and on the small tables."""

import base64
import hashlib
import os
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from flowloom.llm import audit, lloyd, queries, sketches

SF = "/root/testdata/sf0.01"
CLASH = ("id", "row", "keys", "text_", "tie", "bucket", "ahead", "next", "part", "mask", "n", "v", "chunk", "shard", "cluster", "distance", "good", "sha", "no_id", "edited")


def paragraphs(text):
    return set(re.findall(r"[^\n]{1,128}+[^.!?\n]{0,128}+[.!?\n]*+|\n++", text))


def plain_fingerprints(docs):
    """n_chars, edited_sha256, near_edited, near_next by id."""
    rows = sorted((i is None, i, t or "") for i, t in docs)
    out = {}
    for k, (_, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        near = [len(paragraphs(t) & paragraphs(o)) / max(1, len(paragraphs(t) | paragraphs(o))) if t or o else 1.0 for o in (edited, nxt)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def check_fingerprints(rows, docs):
    want = plain_fingerprints(docs)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and set(got) == set(want)
    for i, (n, sha, near_edited, near_next) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12, i


def test_fingerprints_are_the_plain_ones(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() + rng.choice((" ", " ", " ", ". ", "\n", "! ")) for _ in range(n))
    docs = [(3 * i, text(rng.choice((1, 5, 40, 300)))) for i in range(60)]
    docs += [(1, None), (2, ""), (4, docs[0][1]), (5, docs[0][1]), (7, "\n\n\n"), (8, "x" * 5000), (None, text(30)), (10_000, text(9000))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = sketches.compared(df).collect()
    check_fingerprints(out, docs)
    by = {r.doc_id: r for r in out}
    assert by[4].fingerprint == by[5].fingerprint == by[0].fingerprint and by[1].fingerprint == by[2].fingerprint == "0:"
    size, cells = by[0].fingerprint.split(":")
    raw = base64.b64decode(cells)
    assert int(size) == len(paragraphs(docs[0][1])) and len(raw) % 15 == 0 and sum(raw[i + 1] * 256 + raw[i + 2] for i in range(0, len(raw), 15)) == 3 * int(size)
    more = sketches.compared(df.withColumns({c: F.lit(7) for c in CLASH})).collect()
    assert sorted(map(str, more)) == sorted(map(str, out))
    assert sketches.compared(df.limit(0)).count() == 0
    one = sketches.compared(df.where("doc_id = 0")).collect()
    check_fingerprints(one, docs[:1])
    assert one[0].near_next == 1.0
    twice = sketches.with_next(df.where("doc_id < 30").unionByName(df.where("doc_id = 3")).selectExpr("false AS no_id", "doc_id AS id", "xxhash64(text) AS tie", "text"), 3).collect()
    by_id = sorted(twice, key=lambda r: (r.id, r.next.id != r.id))
    assert len(twice) == df.where("doc_id < 30").count() + 1 and [r.next.id for r in by_id] == [r.id for r in by_id[1:]] + [by_id[0].id]


def test_peeling_gives_the_digests_that_differ(spark):
    rng = random.Random(4)
    sets = [(i, rng.sample(range(10**6), n), rng.sample(range(10**6), m)) for i, (n, m) in enumerate([(0, 0), (0, 5), (7, 0), (30, 30), (400, 380), (3000, 10)])]
    sets.append((9, [1, 2, 3, 4], [1, 2, 3, 5]))
    got = {r.k: r for r in sketches.differences(spark.createDataFrame(sets, "k int, left array<bigint>, right array<bigint>"), ["k"]).collect()}
    assert 0 not in got
    for k, a, b in sets[1:]:
        assert sorted(got[k].only_left) == sorted(set(a) - set(b)) and sorted(got[k].only_right) == sorted(set(b) - set(a))


def test_fingerprint_query(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = queries.queries()["op11_document_fingerprints"](spark, SF)
    kinds = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    assert kinds.items() <= dict(df.dtypes).items()
    rows = df.collect()
    check_fingerprints(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert sum(r.near_edited for r in rows) > 10 * sum(r.near_next for r in rows)


def plain_audit(docs, labels):
    """docs: (id, text, part)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    marked = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        marked.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        own, shapley = [m[1:] for m in marked if m[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in m[0] for m in own) - len(gone), sum(m[0] == {f} for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_is_the_plain_one(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(("aa", "b", "CC", "d" * rng.randint(1, 50), "e#", str(rng.random()), "Größe")) for _ in range(n))
    docs = [(i, text(rng.choice((1, 50, 120, 400))), rng.choice(("en", "de", "", None))) for i in range(80)]
    docs += [(100 + i, docs[i % 7][1], "en") for i in range(40)] + [(200, None, "en"), (201, "", "fr"), (None, docs[0][1], "en"), (None, None, None), (0, docs[0][1], "en"), (202, "\t\n ", "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 130, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain_audit(docs, labels)
    for frame in (d, d.withColumns({c: F.lit(7) for c in CLASH if c != "lang"})):
        got = {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in audit.audited(audit.mask_counts(audit.signs(frame, l))).collect()}
        assert got == want
    assert audit.audited(audit.mask_counts(audit.signs(d.limit(0), l.limit(0)))).count() == 0


def plain_lloyd(vectors, dims, k, rounds):
    kept = [(i, [int(1024 * x // 1) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and abs(x) < float("inf") for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    rows = [(i, a, far(v, centroids[a])) for (i, v), a in zip(kept, assign(), strict=True)]
    sums = Counter()
    for _, a, d in rows:
        sums[a] += d
    return sorted((str(i), a, d, sums[a], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for i, a, d in rows)


@pytest.mark.parametrize("k, n", [(3, 60), (8, 5)])
def test_clusters_are_the_plain_ones(spark, k, n):
    rng = random.Random(k)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * rng.choice((1, 20)) for _ in range(6)]) for i in range(n)]
    rows += [(rows[0][0], rows[0][1]), (100, rows[0][1]), (None, [0.5] * 6), (101, None), (102, [1.0] * 5), (103, [1.0, None] * 3), (104, [float("nan")] * 6), (105, [float("-inf")] * 6), (106, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    want = plain_lloyd(rows, 6, k, 4)
    for frame in (df, df.withColumns({c: F.lit(7) for c in CLASH})):
        got = lloyd.cluster(frame, dims=6, k=k, rounds=4, shards=3, per_chunk=7).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want
    assert lloyd.cluster(df.limit(0), dims=6).count() == 0 and lloyd.cluster(df.where("vec_id > 100"), dims=6).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(spark.createDataFrame([(1, [1e9] * 6)], "vec_id bigint, embedding array<double>"), dims=6)


def test_agendas_in_one_array_are_those_by_heap():
    import public_tokenizers as P

    from flowloom.llm import pieces

    v = pieces.Vocabulary(P.path("piece_bpe_32k.model"), check=False)
    rng = random.Random(12)
    letters = "aabcdeehilmnorstuéß日🙂.,12" + pieces.MARK
    segments = list({pieces.MARK * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 63))) for _ in range(1500)} | {"\n", pieces.MARK, "a", "🙂", "aaaaaaaaaaaaaaaa", pieces.MARK + "the"})
    got = v.by_array([s for s in segments if len(s) <= pieces.SHORT])
    for s, ids in zip([s for s in segments if len(s) <= pieces.SHORT], got, strict=True):
        want = v.spelled_out(v.by_heap(s))
        assert ids == want or (ids is None and any(c not in v.ids for c in s)), s
    assert v.merged(segments) == [v.spelled_out(v.by_heap(s)) for s in segments] and v.by_array([]) == []
