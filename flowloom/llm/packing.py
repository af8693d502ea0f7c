"""Best-fit packing of token ids into sequences of several permitted lengths.

What is packed are the ids of each document, as the caller has them (op3: those of a byte-level vocabulary
and an end id). Pieces as long as the longest sequence are cut off and fill one each; what is left of each document is
packed, longest first: into the open sequence with the least room that is still enough or, if there is none, into a
new one of the length whose cost for each place it can be expected to fill is least; at the end each sequence shrinks
to the least permitted length that holds its contents. A sequence of length s costs overhead + s + s*s/quadratic.
A row of the result is a sequence with its ids, and for each piece in it the document, the piece's number and where it
begins; unpacked() gives the documents back.

Each task packs its rows in blocks of about `block` ids, so there is no shuffle, a task's memory is bounded by a block
and the longest document, and no group is gathered; a block's last sequences shrink like all others. Documents of
different blocks never share a sequence. A task that runs again packs the same rows in the same way.

Cases: null ids count as none; a document without ids is a piece of length 0, which goes where there is least room
left, or opens a sequence. Ties in length go by order in the block. Repeated rows are packed each for itself. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, offsets, short_batches, table
from flowloom.llm.token_counts import LibraryIds


class Costs:
    def __init__(self, sizes: tuple[int, ...], overhead: float, quadratic: float) -> None:
        self.sizes = tuple(sorted(set(sizes)))
        if not self.sizes or self.sizes[0] < 1:
            raise ValueError("sizes must be positive")
        self.cost = [overhead + s + s * s / quadratic for s in self.sizes]

    def opened(self, need: int, rest: int) -> int:
        """The size to open for a piece of `need` when all later pieces have `rest` together: least cost for each place filled; of equals the larger."""
        fits = [(c / max(1, min(s, need + rest)), -s) for s, c in zip(self.sizes, self.cost, strict=True) if s >= need]
        return -min(fits)[1]

    def least(self, used: int) -> int:
        return self.sizes[bisect_left(self.sizes, used)]


def best_fit(lengths: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece (none above the largest size): its sequence, where it begins there, and the sequence's final size."""
    order = np.argsort(-lengths, kind="stable")
    where, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, sequence), sorted
    rest = int(lengths.sum())
    for i in order.tolist():
        need = int(lengths[i])
        rest -= need
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, one = room.pop(at)
        else:
            left, one = costs.opened(need, rest), len(used)
            used.append(0)
        where[i], start[i] = one, used[one]
        used[one] += need
        if left > need:
            insort(room, (left - need, one))
    final = np.array([costs.least(u) for u in used], np.int64)
    return where, start, final[where] if len(lengths) else where


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at `begin` and are `size` long, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def pack(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ids_of: Callable[[pa.Array], pa.Array] | None = None, sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), overhead: float = 64, quadratic: float = 65536, block: int = 1 << 20) -> DataFrame:
    """sequence (its name), size, used, ids; and for each piece in it, in order: id_col's value in `owners`, its number in the document in `pieces`, where it begins in `starts`.

    ids_of: gives the ids of the values of ids_col, such as texts; without it they are ids. block: ids that are packed
    together, whole documents always.
    """
    costs, most = Costs(sizes, overhead, quadratic), max(sizes)
    held = F.coalesce(F.col(ids_col).cast("string"), F.lit("")) if ids_of else F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    rows = short_batches(tokens.select(F.col(id_col).alias("id"), held.alias("ids")))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["sequence", "size", "used", "ids", "owners", "pieces", "starts"]

    def packed(name: str, docs: pa.Array, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        count = np.maximum(1, -(-n // most))
        owner = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(most, n[owner] - piece * most)
        where, start, final = best_fit(size, costs)
        order = np.lexsort((start, where))  # stable: a piece without ids stays where it was dealt
        where, start, final, owner, piece, size = (x[order] for x in (where, start, final, owner, piece, size))
        begin = (np.cumsum(n) - n)[owner] + piece * most
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where))
        for a in range(0, len(first), 256):
            f, t = first[a : a + 256], last[a : a + 256]
            s = slice(f[0], t[-1])
            used = np.add.reduceat(size[s], f - f[0])
            at = pa.array(np.append(f - f[0], t[-1] - f[0]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (docs.take(pa.array(owner[s])), pa.array(piece[s], pa.int32()), pa.array(start[s], pa.int32()))]
            held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(used)), pa.int32()), pa.array(gathered(ids, begin[s], size[s]), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{w}" for w in where[f].tolist()]), pa.array(final[f], pa.int32()), pa.array(used, pa.int32()), held, *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, count, number = TaskContext.get().partitionId(), [], 0, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, number
            docs, ids, n = (list(x) for x in zip(*held, strict=True))
            held, count, number = [], 0, number + 1
            yield from packed(f"{task}-{number}", pa.concat_arrays(docs), np.concatenate(ids), np.concatenate(n))

        for b in blocks(batches, "ids") if ids_of else batches:
            own = ids_of(b.column("ids")) if ids_of else b.column("ids")
            ends, values = offsets(own), own.values
            a = 0
            while a < b.num_rows:
                t = min(max(int(np.searchsorted(ends, ends[a] + block - count, side="right")) - 1, a + 1), b.num_rows)
                held.append((b.column("id").slice(a, t - a), values.slice(ends[a], ends[t] - ends[a]).to_numpy(zero_copy_only=False), np.diff(ends[a : t + 1])))
                count += int(ends[t] - ends[a])
                a = t
                if count >= block or a < b.num_rows:
                    yield from flushed()
        if held:
            yield from flushed()

    out = rows.mapInArrow(run, f"sequence string, size int, used int, ids array<int>, owners array<{kind}>, pieces array<int>, starts array<int>")
    return out


def unpacked(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and ids of each document, from the sequences that pack() gives. Documents need different ids."""
    piece = F.explode(F.arrays_zip("owners", "pieces", "starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array("used")).alias("ends")))
    one = sequences.select("ids", piece.alias("p")).select(F.col("p.owners").alias(id_col), F.struct(F.col("p.pieces").alias("piece"), F.slice("ids", F.col("p.starts") + 1, F.col("p.ends") - F.col("p.starts")).alias("ids")).alias("part"))
    return one.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), ids_col="text", ids_of=LibraryIds.public()).withColumnRenamed("owners", "doc_ids")
