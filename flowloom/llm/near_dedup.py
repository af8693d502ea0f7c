"""MinHash near-dedup with tensored banding.

A document's set: its distinct shingles of k words (A-Z lower-cased, words end at ASCII white space); with fewer words
the whole sequence is the one shingle. `groups` small collections of `width` minhashes each are computed, and each
pair of collections forms a table key: groups*(groups-1)/2 tables of 2*width minhashes cost groups*width minhashes.
Two documents are candidates if they agree in at least two collections: with p = J**width that is missed with
probability (1-p)**groups + groups*p*(1-p)**(groups-1), at J = 0.8 and the defaults 0.06 %, at J = 0.85 0.005 %.

Candidates are compared on their full sets. Rows of equal sets are put together first. Within a table key each set is
held against one centre, not against all: first each set with the few centres that it shares most keys with, then one
set of each component of a key with one of the key's largest, at most LATER pairs for two components. Where a key's
members are then not one component, its sets outside the largest one are held against all sets in such keys that three
exact filters leave: shingles have one order, rare ones first, and two similar sets share one early enough for the rest
to reach the overlap they need; and each set carries 1024 marks of which slots hold an odd number of its shingles, so
that marks that differ are shingles that differ. The first two steps cost about a group's size. The last one compares
marks of all pairs of sets of a group that are not yet connected, and verifies those that the marks leave: near the
threshold few (README has figures), but in a group without links the comparisons grow with the square.

Cases: null or blank texts have no set and are linked with nothing. Rows of equal sets are linked whatever their ids.
Rows that share an id are one document in links. A null id is no node: such a row gets the component of the rows with
its set, or null, and is not kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, short_batches, table, utf8, written

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = _rng.integers(1, 1 << 63, (2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    if base not in kept or len(kept[base]) < n:
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        kept[base] = np.cumprod(steps)
    return kept[base][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of bytes that are not gaps, and for each text the index of its first run (and of the end)."""
    gap = gaps[data]
    starts = ~gap
    starts[1:] &= gap[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    starts[first] = ~gap[first]
    stops = ~gap
    stops[:-1] &= gap[1:]
    last = ends[1:][np.diff(ends) > 0] - 1
    stops[last] = ~gap[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(_BASE, len(data)), out=total[1:])
    h = mix((total[e] - total[s]) * powers(_INVERSE, len(data) + 1)[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of k words."""
    h, at = word_hashes(data, ends)
    n = max(0, len(h) - k + 1)
    s = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        s = mix(s * np.uint64(_BASE) + h[j : j + n])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            one = mix(h[a : a + 1] + np.uint64(b - a))
            for j in range(a + 1, b):
                one = mix(one * np.uint64(_BASE) + h[j : j + 1])
            yield one
        else:
            yield h[:0]


def table_keys(shingles: np.ndarray, groups: int, width: int) -> np.ndarray:
    """The keys of all tables: pairs of collections, each of `width` minhashes."""
    n = groups * width
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[None, i : i + 4096] ^ _SEEDS[0, :n, None]) * _SEEDS[1, :n, None]).min(axis=1))
    low = mix(low).reshape(groups, width)
    g = np.zeros(groups, np.uint64)
    for j in range(width):
        g = mix(g * np.uint64(_BASE) + low[:, j])
    i, j = np.triu_indices(groups, 1)
    return mix(g[i] * np.uint64(_BASE) + mix(g[j] + (i * groups + j).astype(np.uint64))).view(np.int64)


def sketch(docs: DataFrame, k: int, groups: int, width: int) -> DataFrame:
    """id, n (set size), whole (128 bits of the set; null without one), keys."""

    def run(batches):
        for b in blocks(batches, "text"):
            n, whole, keys = [], [], []
            for s in shingle_sets(*utf8(b.column("text")), k):
                n.append(len(s))
                whole.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(table_keys(s, groups, width) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "whole", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return short_batches(docs).mapInArrow(run, f"id {kind}, n bigint, whole binary, keys array<bigint>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """id and the distinct shingles of each row."""

    def run(batches):
        for b in blocks(batches, "text"):
            out = [s.view(np.int64) for s in shingle_sets(*utf8(b.column("text")), k)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "shingles"])

    return short_batches(docs).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles array<bigint>")


SLOTS = 1 << 18
#: Words of 64 bits that mark which slots of a set hold an odd number of its shingles.
WORDS = 16
#: How many of a set's centres are tried first.
FIRST = 3
#: How many pairs are then tried at most between two components.
LATER = 16


def slot_counts(rows: DataFrame) -> np.ndarray:
    """How many shingles of rows fall in each of SLOTS slots: a rough frequency, 1 MB whatever the input, by which shingles are put in one order."""
    counts = rows.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(SLOTS)).cast("int").alias("slot")).count().toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("count").to_numpy()
    del counts
    pa.default_memory_pool().release_unused()  # the driver keeps none of the rows
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefixes(rows: DataFrame, slots: np.ndarray, percent: int) -> DataFrame:
    """token, id, n, c, stray, left, odd: each set's first shingles in the order, as many as a similar set of `partner` shingles or more must meet; left: how many there are from this one on. odd: see WORDS."""
    held = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                tokens, owner, left, odd = [], [], [], []
                n, partner = part.column("n").to_numpy(), part.column("partner").to_numpy()
                for i, s in enumerate(part.column("shingles")):
                    own = s.values.to_numpy()
                    least = max(int(partner[i]), -(-percent * int(n[i]) // 100))
                    need = -(-percent * (int(n[i]) + least) // (100 + percent))
                    take = max(0, len(own) - need + 1)
                    first = np.lexsort((own, held.value[own % SLOTS]))[:take]
                    tokens.append(own[first])
                    owner.append(np.full(len(first), i))
                    left.append(len(own) - np.arange(len(first)))
                    bits = np.bincount((own.view(np.uint64) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1
                    odd.append(np.packbits(bits).view(np.int64))
                owner = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *[part.column(c).take(owner) for c in ("id", "n", "c", "stray")], pa.array(np.concatenate(left)), pa.array(odd, pa.list_(pa.int64())).take(owner)], ["token", "id", "n", "c", "stray", "left", "odd"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "n", "c", "stray", "partner", "shingles").mapInArrow(run, f"token bigint, id {kind}, n bigint, c {kind}, stray boolean, left bigint, odd array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id reachable over links (a, b), for the ids in links.

    Each round an id takes the smallest label around it, then that label's own label; rounds grow with the logarithm
    of a chain's length. What each round has is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "links")
    now = written(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), "label")
    while True:
        around = both.join(now, both["b"] == now["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(around, "id", "left").select("id", "component", F.least("component", "near").alias("low"))
        jump = now.select(F.col("id").alias("low"), F.col("component").alias("lower"))
        step = written(step.join(jump, "low", "left").select("id", F.least("low", "lower").alias("component"), (F.least("low", "lower") < F.col("component")).alias("moved")), "label")
        now = step.select("id", "component")
        if not step.where("moved").limit(1).count():
            return now


def everyone(ids: DataFrame, label: DataFrame) -> DataFrame:
    """label (id, component) for all of ids: those without links are components of their own."""
    return written(ids.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "label")


def joined(links: DataFrame, label: DataFrame) -> DataFrame:
    """label (id, component; of all ids in links) after further links: only the pairs of components that they connect go through components()."""
    la = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = links.join(la, "a").join(lb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    higher = components(pairs).select(F.col("id").alias("component"), F.col("component").alias("low"))
    return written(label.join(higher, "component", "left").select("id", F.coalesce("low", "component").alias("component")), "label")


def unlike(percent: int) -> Column:
    """Whether the marks of two sets (columns x and y) show that they are less similar: each odd bit that differs stands for a shingle that only one of them has."""
    odd = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(WORDS)), F.lit(0))
    return F.lit(100 + percent) * odd > F.lit(100 - percent) * (F.col("nx") + F.col("ny"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, groups: int = 14, width: int = 3, broadcast_ids: int = 2_000_000) -> DataFrame:
    """id, n_shingles, component_id, kept for each row. Links: 100 * intersection >= percent * union, on full sets.

    broadcast_ids: up to so many candidate ids (8 bytes each) are broadcast to pick out their texts; more are joined by shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = written(sketch(rows, k, groups, width), "sketch")
    reps = marks.where("whole is not null").groupBy("whole").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    reps = written(reps.where("rep is not null"), "reps")

    # One row for each set and table. Most keys have one member: a count, summed before the shuffle, leaves the rest.
    chosen = marks.where("id is not null").join(reps.select(F.col("rep").alias("id"), F.col("whole")), ["id", "whole"], "left_semi")
    exploded = chosen.select("id", "n", F.explode("keys").alias("key"))
    several = exploded.groupBy("key").count().where("count > 1").select("key")
    members = written(exploded.join(several, "key"), "members")

    wanted = written(members.select("id").distinct(), "wanted")
    few = wanted.count() <= broadcast_ids
    texts = rows.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    full = written(sets(texts, k), "sets").where("size(shingles) > 0")

    def linked(some: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are similar enough. Nothing stands on the joins, so that a frequent id's partition can be split."""
        left = full.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        right = full.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        held = some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), F.size("x").alias("nx"), F.size("y").alias("ny"))
        return held.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("both"))).select("a", "b")

    def fits(n: str, m: str) -> Column:
        return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)

    # Each key has a centre, another one in each table. First each set's most frequent centres.
    centre = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("o"), F.col("id"), F.col("n"))).alias("c"))
    around = members.join(centre.select("key", F.col("c.id").alias("a"), F.col("c.n").alias("an")), "key").where((F.col("id") != F.col("a")) & fits("n", "an"))
    shared = around.groupBy(F.col("id").alias("b"), "a").agg(F.count(F.lit(1)).alias("keys"))
    # An id has at most one centre in each table, so the list is short.
    best = shared.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("keys", "a")), False), 1, FIRST).alias("c"))
    tried = written(best.select("b", F.explode("c.a").alias("a")), "pairs")
    label = everyone(wanted, components(written(linked(tried), "linked")))

    def parts(label: DataFrame) -> DataFrame:
        """key, c, m, least, x for each component of each key that is in several: its members there, the least size of a set, one of its sets; main, y: the same of the key's largest."""
        at = members.join(label, "id")
        one = F.min(F.struct(F.xxhash64("key", "id", "component").alias("o"), F.col("id"), F.col("n")))
        each = written(at.groupBy("key", F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), one.alias("x")), "parts")
        key = each.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c", F.col("x").alias("y"))).alias("main"), F.min("least").alias("partner"))
        return each.join(key.where("parts > 1").select("key", F.col("main.c").alias("main"), F.col("main.y").alias("y"), "partner"), "key")

    # Then, for what is not connected by now, one set of each component of a key against one of its largest. Two
    # components may meet in many keys: of their pairs, dealt into LATER lots, the most frequent of each.
    apart = parts(label).where(F.col("c") != F.col("main")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "c", "main", F.col("x.n").alias("n"), F.col("y.n").alias("m"))
    apart = apart.where(fits("n", "m")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"), F.first("c").alias("c"), F.first("main").alias("main"))
    apart = apart.groupBy(F.least("c", "main"), F.greatest("c", "main"), F.pmod(F.xxhash64("a", "b"), F.lit(LATER))).agg(F.max_by(F.struct("a", "b"), F.struct("keys", "a", "b")).alias("p")).select("p.a", "p.b")
    label = joined(written(linked(apart), "linked"), label)

    # Keys whose members are not yet one component: sets outside the key's largest one are held against all others by
    # exact prefix filtering, whatever keys they share. partner: the least size of a set in a key with this one.
    open_keys = parts(label).select("key", "c", "main", "partner")
    at = members.join(label.withColumnRenamed("component", "c"), "id").join(open_keys, ["key", "c"])
    opened = written(at.groupBy("id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.bool_or(F.col("c") != F.col("main")).alias("stray"), F.min("partner").alias("partner")), "open")
    held = full.join(F.broadcast(opened) if few else opened, "id")
    slots = slot_counts(held)
    tokens = written(prefixes(held, slots, percent), "prefix")
    x = tokens.where("stray").select("token", F.col("id").alias("xid"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("left").alias("lx"), *[F.col("odd")[i].alias(f"x{i}") for i in range(WORDS)])
    y = tokens.select("token", F.col("id").alias("yid"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("left").alias("ly"), F.col("stray").alias("sy"), *[F.col("odd")[i].alias(f"y{i}") for i in range(WORDS)])
    near = (x["token"] == y["token"]) & (F.col("cx") != F.col("cy")) & (~F.col("sy") | (F.col("yid") < F.col("xid"))) & fits("nx", "ny")
    near = near & (F.lit(100 + percent) * F.least("lx", "ly") >= F.lit(percent) * (F.col("nx") + F.col("ny"))) & ~unlike(percent)
    rest = x.join(y, near).groupBy(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).agg(F.count(F.lit(1)).alias("tokens"))
    last = written(linked(written(rest, "rest")), "linked")
    if last.limit(1).count():
        label = joined(last, label)

    whole = reps.join(label, reps["rep"] == label["id"], "left").select("whole", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "n", "whole").join(whole, "whole", "left")
    component = F.when(F.col("whole").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 2_000_000, **how) -> DataFrame:
    """The rows of docs that stay, one document of each group of near duplicates; rows without an id stay."""
    dropped = written(near_duplicates(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct(), "dropped")
    gone = F.broadcast(dropped) if dropped.count() <= broadcast_ids else dropped
    return docs.join(gone, id_col, "left_anti")


def op9_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
