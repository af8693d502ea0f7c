"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding: blanks become the mark U+2581, one more mark goes in front, and the symbols of the text are merged by an
agenda of adjacent pairs, best score first and leftmost of equals; the agendas of many short segments are one array. No piece of such a vocabulary has a mark behind
another character, so a merge never crosses the place before a mark: a text is cut there (and beside line ends, which
no longer piece holds; both are verified when the vocabulary is loaded), and a worker remembers the ids of segments
it has met, as they are written, and what they decode to. Each new segment's ids are held against the sentencepiece library's, batch by batch; a difference ends
the job. Decoding joins the pieces' bytes, byte pieces included, and takes off the mark in front.

Cases: a null or empty text has only the end id and decodes to the empty text. Texts are never cut short; a word of
any length costs n log n. Repeated rows give repeated rows, an empty table none. Other columns are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import blocks, short_batches, table

MARK = "▁"
#: Up to so many characters segments are merged together in arrays; beyond, each by a heap. NONE: no piece; an agenda's number is a place among the scores and, in its low AT bits, where the pair stands.
SHORT, NONE, AT = 64, 1 << 20, 40
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    def __init__(self, path: str, remember: int = 1_200_000, check: bool = True) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.remember, self.check = self.library, remember, check
        size = range(sp.get_piece_size())
        text = [sp.id_to_piece(i) for i in size]
        plain = [i for i in size if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {text[i]: i for i in plain}
        place = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}  # equal scores share one
        self.rank = {text[i]: place[sp.get_score(i)] for i in plain}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte = {int(text[i][3:5], 16): i for i in size if sp.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids if len(p) > 1):
            raise ValueError("a piece goes over the place where texts are cut")
        self.cut = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.numbers = [str(i) for i in size]
        self.bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in size]
        self.pairs()
        self.known: dict[str, str] = {}  # a segment's ids in decimal, joined by blanks
        self.older: dict[str, str] = {}  # what was known before the last change of generations
        self.odd: dict[str, bytes] = {}  # what the ids of a segment decode to, where that is not the segment itself

    def pairs(self) -> None:
        """The agenda's table: each pair of symbols that a piece can be made of, as one number, with the piece's place among the scores. Symbols are pieces and the characters of pieces."""
        self.symbol = {p: n for n, p in enumerate({*self.ids, *(c for p in self.ids for c in p)})}
        self.spare = len(self.symbol)  # stands for all other characters
        rows = sorted((self.symbol[p[:k]] * (self.spare + 1) + self.symbol[p[k:]], self.rank[p], self.symbol[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self.pair, self.place, self.made = (np.array([r[i] for r in rows] or [-1], np.int64) for i in range(3))
        self.number_of = np.full(self.spare + 1, -1, np.int64)
        for p, n in self.symbol.items():
            self.number_of[n] = self.ids.get(p, -1)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of pairs among the scores (NONE: no piece), and what they make."""
        keys = left * (self.spare + 1) + right
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        return np.where(self.pair[at] == keys, self.place[at], NONE), self.made[at]

    def merged(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, by the agenda that suits its length."""
        short = [s for s in segments if len(s) <= SHORT]
        found = dict(zip(short, self.by_array(short), strict=True))
        return [ids if (ids := found.get(s)) else self.spelled_out(self.by_heap(s)) for s in segments]

    def spelled_out(self, symbols: list[str]) -> list[int]:
        """Ids of symbols, empty ones left out; a character that is no piece goes by its bytes."""
        out: list[int] = []
        for s in symbols:
            if s:
                one = self.ids.get(s)
                out += [one] if one is not None else [self.byte[b] for b in s.encode()] if self.byte else [self.unknown]
        return out

    def by_array(self, segments: list[str]) -> list[list[int] | None]:
        """The agendas of all segments are one array of their adjacent pairs; in each round the best of each segment, the leftmost of equals, is merged. None where a character is no piece."""
        if not segments:
            return []
        codes, which = np.unique(np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32), return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), self.spare) for c in codes], np.int64)[which]
        number, size = np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(size)
        rank, made = (np.append(x, NONE) for x in self.look(sym[:-1], sym[1:]))
        rank[ends - 1] = NONE
        out: list[list[int] | None] = [None] * len(segments)
        while len(number):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat((rank << AT) + np.arange(len(rank)), first)
            going = best < NONE << AT
            if not going.all():
                done = ~going
                ids, to = self.number_of[sym[np.repeat(done, size)]], np.cumsum(size[done])
                whole = (np.minimum.reduceat(ids, to - size[done]) >= 0).tolist()
                values, a = ids.tolist(), 0
                for n, e, ok in zip(number[done].tolist(), to.tolist(), whole, strict=True):
                    out[n], a = values[a:e] if ok else None, e
                stays = np.repeat(going, size)
                sym, rank, made = sym[stays], rank[stays], made[stays]
                gone = np.cumsum(np.where(going, 0, size))  # of places in front
                at = (best & ((1 << AT) - 1))[going] - gone[going]
                number, size = number[going], size[going]
                if not len(number):
                    break
            else:
                at = best & ((1 << AT) - 1)
            sym[at] = made[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sym, rank, made = sym[left], rank[left], made[left]
            at, size = at - np.arange(len(at)), size - 1  # one place less for each segment before
            first = np.cumsum(size) - size
            inner = at < first + size - 1
            rank[at] = NONE
            rank[at[inner]], made[at[inner]] = self.look(sym[at[inner]], sym[at[inner] + 1])
            before = at[at > first] - 1
            rank[before], made[before] = self.look(sym[before], sym[before + 1])
        return out

    def by_heap(self, segment: str) -> list[str]:
        """The agenda is a heap; it holds a pair's place among the scores and, in the low bits, its left symbol, as one number. A merged symbol is empty."""
        rank, n = self.rank.get, len(segment)
        symbols, after, before = list(segment), list(range(1, n + 1)), list(range(-1, n))
        shift = n.bit_length()
        low = (1 << shift) - 1
        agenda = [r << shift | i for i in range(n - 1) if (r := rank(segment[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            key = heapq.heappop(agenda)
            i = key & low
            j = after[i]
            if j >= n or not symbols[i] or rank(pair := symbols[i] + symbols[j]) != key >> shift:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            before[k] = i
            if k < n and (r := rank(pair + symbols[k])) is not None:
                heapq.heappush(agenda, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, r << shift | h)
        return symbols

    def learn(self, segments: list[str]) -> None:
        new = self.merged(segments)
        if self.check:
            # The library puts a mark in front; a line end in front keeps a segment without one apart from it.
            asked = [s[1:] if s[0] == MARK else "\n" * (s != "\n") + s for s in segments]
            for s, mine, theirs in zip(segments, new, self.library.encode(asked, num_threads=1), strict=True):
                theirs = theirs if s[0] == MARK else theirs[1 + (s != "\n") :]
                if s != MARK and mine != theirs:
                    raise ValueError(f"segment {s!r}: {mine} here, {theirs} by the library")
        number, of, known = self.numbers.__getitem__, self.bytes.__getitem__, self.known
        decoded = [b"".join(map(of, ids)) for ids in new]
        self.odd.update((s, d) for s, d in zip(segments, decoded, strict=True) if d != s.replace(MARK, " ").encode())
        for s, ids in zip(segments, new, strict=True):
            known[s] = " ".join(map(number, ids))

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Each text's segments, all of them in `known` then; `known` may be another table than before.

        Two generations, each of half of what is to be remembered (or of one call's segments, if these are more): what is met goes into the younger.
        """
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        here = set(chain.from_iterable(cut))
        if len(self.known) > self.remember // 2:
            self.older, self.known = self.known, {}
            self.odd = {s: d for s, d in self.odd.items() if s in self.older}
        if missing := [s for s in here if s not in self.known]:
            self.known.update((s, self.older[s]) for s in missing if s in self.older)
            if new := [s for s in missing if s not in self.known]:
                self.learn(new)
        return cut

    def spelled(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text the ids in decimal, the end id included, and what they decode to: both put together from the segments'."""
        cut = self.segments(texts)
        get, end, out = self.known.__getitem__, self.numbers[self.end], []
        for segments in cut:
            ids = " ".join([*map(get, segments), end])
            if not segments:
                out.append((ids, ""))
                continue
            if self.odd and not self.odd.keys().isdisjoint(segments):
                decoded = b"".join([self.odd[s] if s in self.odd else s.replace(MARK, " ").encode() for s in segments]).decode("utf-8", "each_byte")
            else:
                decoded = "".join(segments).replace(MARK, " ")
            marked = decoded[:1] == " " and self.marked(list(map(int, self.known[segments[0]].split(" "))))
            out.append((ids, decoded[1:] if marked else decoded))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id included."""
        return [list(map(int, ids.split(" "))) for ids, _ in self.spelled(texts)]

    def decode(self, ids: list[int]) -> str:
        of = self.bytes
        text = b"".join([of[i] for i in ids]).decode("utf-8", "each_byte")
        return text[1:] if text[:1] == " " and self.marked(ids) else text

    def marked(self, ids: list[int]) -> bool:
        """Whether the first piece that is not a control piece begins with the mark."""
        first = next((i for i in ids if self.bytes[i]), self.unknown)
        return first != self.unknown and not self.library.is_byte(first)


@lru_cache(maxsize=4)
def vocabulary(path: str, remember: int, check: bool) -> Vocabulary:
    return Vocabulary(path, remember, check)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_200_000, check: bool = True) -> DataFrame:
    """id and the ids of each text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        v = vocabulary(path, remember, check)
        for b in blocks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(v.encode(b.column("text").to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])

    return short_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and the text that the ids stand for."""
    rows = encoded.select(F.col(id_col).alias("id"), "ids")

    def run(batches):
        v = vocabulary(path, 0, False)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], ["id", "ids", "decoded"])

    return short_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_200_000, check: bool = True) -> DataFrame:
    """id, n_tokens and hashes of the ids and of the text decoded from them: encode and decode in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        v = vocabulary(path, remember, check)
        for b in blocks(batches, "text", 1 << 20):
            both = v.spelled(b.column("text").to_pylist())
            hashes, decoded = ([hashlib.sha256(x[i].encode()).hexdigest() for x in both] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([ids.count(" ") + 1 for ids, _ in both], pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return short_batches(rows).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
