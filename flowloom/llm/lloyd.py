"""Centroid clustering: Lloyd's algorithm with the dimensions dealt over column blocks, exact in whole numbers.

Kept vectors become whole numbers and are written once as rows (chunk, shard, block): some thousand vectors by the
components of one shard. In each round a task sees blocks and its shard's slice of the centroids and gives exact partial
distances; reducing by chunk adds the blocks' and takes the nearest centroid; the assignments, a byte for each vector,
meet the blocks again, and each shard sums up its own slice. The blocks lie in buckets by chunk, so only partial
distances and assignments are shuffled, never vectors. The driver sees one row for each centroid and component.

Cases: vectors of another length, or with a null, NaN or infinite component, and null vectors are left out. A component
beyond +-2**28 after scaling ends the job: distances then no longer fit 64 bits. Ties go to the smaller centroid.
Repeated rows are vectors of their own; equal ids among the first centroids are ordered by their components, null ids
come last. With fewer vectors than centroids there are as many centroids as vectors. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import bucketed, table, written

MOST = 1 << 28


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """id and v (array of doubles) of the vectors that are kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(values * scale)
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"a component is beyond {MOST / scale}")
    return out.astype(np.int64)


def bounds(dims: int, shards: int) -> list[tuple[int, int]]:
    """The components of each shard."""
    cuts = [dims * s // shards for s in range(shards + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def blocked(kept: DataFrame, dims: int, shards: int, scale: int, per_chunk: int) -> DataFrame:
    """chunk, shard, n, block (32-bit numbers, a row for each vector), ids (in the first shard's row alone), as a table in buckets by chunk."""
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        for b in batches:
            for at in range(0, b.num_rows, per_chunk):
                part = b.slice(at, per_chunk)
                x = scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale).astype("<i4")
                chunk, none = next(number), pa.scalar(None, pa.list_(part.column("id").type))
                for s, (a, e) in enumerate(bounds(dims, shards)):
                    ids = pa.array([part.column("id").to_pylist() if s == 0 else none.as_py()], pa.list_(part.column("id").type))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([s], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([x[:, a:e].tobytes()], pa.binary()), ids], ["chunk", "shard", "n", "block", "ids"])

    return bucketed(kept.mapInArrow(run, f"chunk bigint, shard int, n int, block binary, ids array<{kind}>"), "chunk", "blocks")


def assigned(blocks: DataFrame, centroids: list[list[int]], cut: list[tuple[int, int]]) -> DataFrame:
    """chunk, cluster (a byte or two for each vector), distance (64 bits for each): partial distances of the blocks, added by chunk."""

    def partial(batches):
        for b in batches:
            for shard, n, block, chunk in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "block", "chunk")), strict=True):
                x = np.frombuffer(block, "<i4").reshape(n, -1).astype(np.int64)
                a, e = cut[shard]
                d = np.column_stack([((x - np.array(c[a:e], np.int64)) ** 2).sum(axis=1) for c in centroids])
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "n": pa.array([n], pa.int32()), "d": pa.array([d.astype("<i8").tobytes()], pa.binary())})

    def nearest(rows: pa.Table) -> pa.Table:
        """One row for each shard of a chunk."""
        n = rows.column("n")[0].as_py()
        d = sum(np.frombuffer(x, "<i8").reshape(n, -1) for x in rows.column("d").to_pylist())
        best = d.argmin(axis=1)  # the first of equals
        return pa.table({"chunk": rows.column("chunk")[:1], "cluster": pa.array([best.astype("<i2").tobytes()], pa.binary()), "distance": pa.array([d[np.arange(n), best].astype("<i8").tobytes()], pa.binary())})

    parts = blocks.select("chunk", "shard", "n", "block").mapInArrow(partial, "chunk bigint, n int, d binary")
    return parts.groupBy("chunk").applyInArrow(nearest, "chunk bigint, cluster binary, distance binary")


def moved(blocks: DataFrame, clusters: DataFrame, centroids: list[list[int]], cut: list[tuple[int, int]]) -> list[list[int]]:
    """The centroids after one update: each shard's tasks sum up its slice of each cluster's vectors."""
    k = len(centroids)

    def run(batches):
        total = [np.zeros((k, e - a + 1), np.int64) for a, e in cut]  # the last column counts
        for b in batches:
            for shard, n, block, cluster in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "block", "cluster")), strict=True):
                x = np.frombuffer(block, "<i4").reshape(n, -1).astype(np.int64)
                np.add.at(total[shard], np.frombuffer(cluster, "<i2"), np.column_stack([x, np.ones(n, np.int64)]))
        rows = [(s, c, i, int(v)) for s, t in enumerate(total) for c in range(k) if t[c, -1] for i, v in enumerate(t[c])]
        yield pa.RecordBatch.from_pydict({name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate((("shard", pa.int32()), ("cluster", pa.int32()), ("i", pa.int32()), ("v", pa.int64())))})

    both = blocks.select("chunk", "shard", "n", "block").join(clusters.select("chunk", "cluster"), "chunk")
    sums = both.mapInArrow(run, "shard int, cluster int, i int, v bigint").groupBy("shard", "cluster", "i").agg(F.sum("v").alias("v")).collect()
    held = {(r.shard, r.cluster, r.i): r.v for r in sums}
    out = [list(c) for c in centroids]
    for s, (a, e) in enumerate(cut):
        for c in range(k):
            if n := held.get((s, c, e - a)):
                out[c][a:e] = [held[s, c, i] // n for i in range(e - a)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, shards: int = 2, scale: int = 1024, per_chunk: int = 4096) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    Vectors count as floor(scale * x). The first centroids are the k vectors with the least sha256 of `seed:id`.
    """
    kept = whole_vectors(vectors, id_col, vector_col, dims)
    first = kept.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.col("key").asc_nulls_last(), "v").limit(k)
    centroids = [[int(x) for x in scaled(np.array(r.v), scale)] for r in first.select("v").collect()]
    kind = kept.schema["id"].dataType.simpleString()
    if not centroids:
        return kept.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]).limit(0)
    cut = bounds(dims, shards)
    blocks = blocked(kept, dims, shards, scale, per_chunk)
    for _ in range(rounds):
        centroids = moved(blocks, assigned(blocks, centroids, cut), centroids, cut)

    def rows(batches):
        for b in batches:
            for ids, c, d in zip(b.column("ids"), b.column("cluster").to_pylist(), b.column("distance").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(c, "<i2").astype(np.int32)), pa.array(np.frombuffer(d, "<i8"))], ["id", "cluster", "distance"])

    last = blocks.where("shard = 0").select("chunk", "ids").join(assigned(blocks, centroids, cut), "chunk")
    out = written(last.mapInArrow(rows, f"id {kind}, cluster int, distance bigint"), "clusters")
    by = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, t: F.element_at(F.lit([v for v in values]).cast(f"array<{t}>"), F.col("cluster") + 1)
    return out.select(F.col("id").alias(id_col), "cluster", "distance", of([by.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"), F.lit(sum(by.values())).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def op13_centroid_clustering(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(rounds: int = 10, dims: int = 64, k: int = 8) -> str:
    """Long rows (vector, component, value), and two tables for each round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "x AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, unnest(range(1, 65)) AS u(i))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM f JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (i) GROUP BY vec_id, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{r} LEFT JOIN s{r} USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"


SQL = _sql()
