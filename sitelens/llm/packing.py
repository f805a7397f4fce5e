"""Packing of tokenised documents by minimum bin slack.

A task tokenises whole texts and packs what it reads; nothing is shuffled, and the same input gives the same pieces
again after a lost executor. Full windows of a long document are sequences of their own; its remainder joins a pool of
bounded size. From the pool each window takes its longest piece and then the multiset of lengths that fills it closest
to capacity, found by a bitset subset-sum over lengths with counts and backtracked. Where no multiset fills a window, one
more piece is cut for the rest. At the end of a task the last tokens go to sequences of power-of-two lengths, so that
nothing is padded.

Tokens: the vocabulary's pieces (words, digits, runs of marks) are encoded once each and kept in a bounded table; texts
with characters beyond 255, special tokens' openings or separators 28 to 31 go to the tokenizer whole.

Defined cases: null text counts as empty and gives one piece, the end token alone; repeated rows and repeated or null
doc_ids are documents each; very long texts are encoded whole; of equally long pieces the one that came last is taken
first; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, tidied, worker_cache

#: Pieces kept between tasks of a worker; then the table starts anew.
WORDS = 500_000
#: Tokens in the pool before windows are taken from it, in windows.
POOL = 64
_LETTER, _NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's own rule for pieces, for characters below 256.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_ODD = re.compile("[\x1c-\x1f]|<\\|")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


_BYTE = _byte_symbols()


def _plain(text: str) -> bool:
    """Whether pieces of the text can be looked up: below 256 lower case and composition change nothing else."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not _ODD.search(text)


class WordTable:
    """Token ids of texts by a table of their words."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(WORDS + 1, np.int64)
        self.used = 0

    def add(self, new: list[str]) -> None:
        ids, sizes, tokenize = [], [], self.encoder.model.tokenize
        for w in new:
            own = [t.id for t in tokenize(w if w.isascii() and w.isprintable() else "".join(_BYTE[b] for b in w.encode()))]
            ids += own
            sizes.append(len(own))
        k = len(self.place)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(new) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k + 1 : k + 1 + len(new)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.place.update(zip(new, range(k, k + len(new))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as the tokenizer gives them for the whole text."""
        words = [_PIECE.findall(t.lower()) if _plain(t) else None for t in texts]
        place = self.place
        every = set().union(*(own for own in words if own))
        new = every.difference(place)
        if len(place) + len(new) > WORDS and place:
            self.clear()
            place = self.place
            new = every
        if new:
            self.add(list(new))
        out = []
        for t, own in zip(texts, words, strict=True):
            if own is None:
                out.append(np.array(self.encoder.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            k = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            lo, n = self.start[k], self.start[k + 1] - self.start[k]
            end = np.cumsum(n)
            out.append(self.flat[np.repeat(lo - end + n, n) + np.arange(end[-1] if len(end) else 0)])
        return out


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The counts of lengths, within those there are, whose sum is the largest of at most ``room``."""
    reach, mask = [1], (1 << (room + 1)) - 1
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x]]
    used = []
    for x in lengths:
        now, left, step = reach[-1], min(counts[x], room // x), 1
        while left > 0:
            take = min(step, left)
            now |= (now << (take * x)) & mask
            left -= take
            step *= 2
        reach.append(now)
        used.append(x)
        if now >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, {}
    for i in range(len(used) - 1, -1, -1):
        k = 0
        while not reach[i] >> (at - k * used[i]) & 1:
            k += 1
        if k:
            out[used[i]] = k
            at -= k * used[i]
    return out


class Packer:
    """Takes documents' ids; gives pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.sequence = capacity, first
        self.pool: dict[int, list[tuple]] = {}
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for a in range(0, n - self.capacity + 1, self.capacity):
            self.emit([(doc_id, a, ids[a : a + self.capacity], n)])
        a = n - n % self.capacity
        if a < n:
            self.keep((doc_id, a, ids[a:].copy(), n))
            if self.held >= 2 * POOL * self.capacity:
                while self.held >= POOL * self.capacity:
                    self.window()

    def keep(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.held += len(piece[2])

    def take(self, length: int) -> tuple:
        own = self.pool[length]
        piece = own.pop()
        if not own:
            del self.pool[length]
        self.held -= length
        return piece

    def window(self) -> None:
        pieces = [self.take(max(self.pool))]
        room = self.capacity - len(pieces[0][2])
        for x, k in fill({x: len(own) for x, own in self.pool.items()}, room).items():
            pieces += [self.take(x) for _ in range(k)]
            room -= x * k
        if room and self.pool:
            d, s, ids, n = self.take(max(self.pool))
            pieces.append((d, s, ids[:room], n))
            self.keep((d, s + room, ids[room:], n))
        self.emit(pieces)

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for d, s, ids, n in pieces:
            self.out.append((d, s, ids, n, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        while self.held >= self.capacity:
            self.window()
        rest = [self.take(x) for x in sorted(self.pool, reverse=True) for _ in range(len(self.pool[x]))]
        left = sum(len(p[2]) for p in rest)
        while left:
            size, own = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                d, s, ids, n = rest.pop(0)
                own.append((d, s, ids[:size], n))
                if len(ids) > size:
                    rest.insert(0, (d, s + size, ids[size:], n))
                size -= len(own[-1][2])
            self.emit(own)


_FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end: int, capacity: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer, kind = worker_cache(f"words {path}", lambda: WordTable(path)), Packer(capacity, TaskContext.get().partitionId() << 33), None

        def rows() -> pa.RecordBatch:
            own, packer.out = packer.out, []
            c = lambda k, t: pa.array([x[k] for x in own], t)
            return pa.record_batch([c(0, kind), c(1, pa.int64()), pa.array([len(x[2]) for x in own], pa.int64()), pa.array([x[2].astype("<u4").tobytes() for x in own], pa.binary()), c(3, pa.int64()), c(4, pa.int64()), c(5, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, 4000, f"words {path}"):
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            a = 0
            while a < len(ids):
                own, size = [], 0
                while a + len(own) < len(ids) and size < 100_000:
                    own.append(texts[a + len(own)].as_py() or "")
                    size += len(own[-1])
                for d, x in zip(ids[a : a + len(own)], table.encode(own), strict=True):
                    packer.add(d, np.append(x, np.uint32(end)))
                a += len(own)
                if len(packer.out) > 2000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, capacity: int = 4096) -> DataFrame:
    """Rows doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset; one per piece."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pack(path, end, capacity), f"doc_id {kind}, {_FIELDS}")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; a row per piece."""
    p = pack(documents(spark, sf_dir))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_pack": op1_pack}
ORACLE_SQL: dict[str, str] = {}
