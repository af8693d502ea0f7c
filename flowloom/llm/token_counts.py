"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a batch that a worker has not
met lately are held as one ragged numpy array of symbols; each round every pre-token's lowest-rank pair is merged at
once (of overlapping places of one pair the left ones, as one after the other would), only ranks beside a merge are
looked up again, and pre-tokens without a pair drop out with their symbol count.

Cases: a null or empty text has 0 bytes and 0 tokens. A special token's string inside a text is one token, as the
library has it by default. Texts are never cut; a batch is handled in blocks of some MB. Repeated rows give repeated
rows, an empty table none. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm.common import blocks, offsets, short_batches, table

#: The published pattern of this family of vocabularies, with white space as Unicode has it. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.iinfo(np.int32).max


class Merges:
    """Ranks of symbol pairs, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids = model["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        left, right, new = (np.array([ids[x] for x in part], np.int64) for part in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.new = key[order], order.astype(np.int32), new.astype(np.int32)
        self.bytes = np.array([ids[c] for c in byte_names()], np.int32)
        self.special = [t["content"] for t in model["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def byte_names() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def count_symbols(tokens: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols each token has once no pair of it can be merged."""
    count = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ids = merges.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
    seq = np.repeat(np.arange(len(tokens)), count)
    if not len(ids):
        return count
    rank = np.full(len(ids), NONE, np.int32)
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner] = merges.rank(ids[inner], ids[inner + 1])
    while True:
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        lengths = np.diff(np.append(starts, len(seq)))
        low = np.minimum.reduceat(rank, starts)
        count[seq[starts]] = lengths
        live = np.repeat(low < NONE, lengths)
        if not live.any():
            return count
        low = np.repeat(low, lengths)[live]
        ids, seq, rank = ids[live], seq[live], rank[live]
        hit = np.flatnonzero(rank == low)
        fresh = np.concatenate(([True], np.diff(hit) != 1))
        run_start = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
        hit = hit[(hit - run_start) % 2 == 0]
        ids[hit] = merges.new[rank[hit]]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        ids, seq, rank = ids[keep], seq[keep], rank[keep]
        again = np.unique(np.concatenate((at, at[at > 0] - 1)))
        rank[again] = NONE
        again = again[again + 1 < len(seq)]
        again = again[seq[again] == seq[again + 1]]
        rank[again] = merges.rank(ids[again], ids[again + 1])


@lru_cache(maxsize=4)
def counter(path: str, most: int) -> Counter:
    return Counter(Merges(path), most)


class Counter:
    """Counts of texts; remembers at most `most` pre-tokens."""

    def __init__(self, merges: Merges, most: int) -> None:
        self.merges, self.most, self.known = merges, most, {}
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def tokens(self, text: str) -> tuple[list[str], int]:
        if not self.special or not any(s in text for s in self.merges.special):
            return self.cut.findall(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.cut.findall(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.tokens(t) for t in texts]
        here = {t for tokens, _ in cut for t in tokens}
        if len(self.known) > self.most:  # what is met here again stays
            self.known = {t: self.known[t] for t in here if t in self.known}
        if new := [t for t in here if t not in self.known]:
            self.known.update(zip(new, count_symbols([t.encode() for t in new], self.merges).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, tokens)) + n for tokens, n in cut]


@lru_cache(maxsize=2)
def library(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=of, special_tokens={})


@lru_cache(maxsize=2)
def plain_library(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class LibraryIds:
    """Ids of texts, special strings as ordinary text, with an end id behind: for operators that take ids. Called with an array of texts.

    The faster library can't take a million blanks or more in a row; the other one, of the same vocabulary, takes such texts.
    """

    def __init__(self, ranks: str, pattern: str, json_path: str, end: int) -> None:
        self.ranks, self.pattern, self.json_path, self.end = ranks, pattern, json_path, end

    def one(self, text: str) -> np.ndarray:
        try:
            return library(self.ranks, self.pattern).encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return np.array(plain_library(self.json_path).encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: pa.Array) -> pa.Array:
        ids = [self.one(t) for t in texts.fill_null("").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids], dtype=np.int64)))
        values = np.full(ends[-1], self.end, np.int32)
        values[np.delete(np.arange(ends[-1]), ends[1:] - 1)] = np.concatenate(ids) if ids else []
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    @staticmethod
    def public() -> LibraryIds:
        """Of the public vocabulary byte_bpe_50k, whose free id 50256 ends a text."""
        import public_tokenizers as P

        return LibraryIds(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"), 50256)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, remember: int = 400_000) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. path: the vocabulary's file, on every machine."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        of = counter(path, remember)
        for b in blocks(batches, "text", 1 << 20):
            n = of.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets(b.column("text"))), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = short_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
