"""Lexical retrieval packing: BM25 neighbours fill each seed document's window of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, table
from .tokens import encoder, small_batches, vocabulary_path

LENGTH = 1024
#: Documents in one shard of the inverted index; a shard's postings are held by one task at a time.
SHARD = 2048
#: A seed asks with its so many heaviest terms (by inverse document frequency).
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: Partitions of the index, as a multiple of the shuffle partitions, at most.
MOST_PARTS = 8
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False))


def _encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of two kinds: whole windows of a document (one piece, one sequence), and its tail of under LENGTH ids,
    with the tail's ids and its term of least frequency in the vocabulary's order (high ids are rare)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, windows, rows = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for b in small_batches(batches):
            out, (all_ids, ends) = [], enc.encode(b.column(1).to_pylist())
            narrow = all_ids.astype(_type(enc.size))
            for doc, lo, hi in zip(b.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                n = hi - lo
                whole = n // LENGTH
                for k in range(whole):
                    out.append((doc, k * LENGTH, LENGTH, _crc(all_ids[lo + k * LENGTH : lo + (k + 1) * LENGTH]), n, 2 * ((part << 40) + windows), None, None, None))
                    windows += 1
                if n % LENGTH:
                    tail = narrow[lo + whole * LENGTH : hi]
                    out.append((doc, whole * LENGTH, n - whole * LENGTH, 0, n, 0, tail.tobytes(), int(tail.max()), (part << 40) + rows))
                    rows += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field(0).type, *[pa.int64()] * 5, pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "tail", "term", "row"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, tail binary, term int, row long")


def _type(size: int) -> str:
    """How ids of a vocabulary of ``size`` are stored in tails."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Shard:
    """Inverted index of one shard's tails and the greedy filling of windows."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float):
        self.tails = tails
        self.size = np.array([len(t) for t in tails])
        owner = np.repeat(np.arange(len(tails)), self.size)
        key, count = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + owner, return_counts=True)
        term, doc = key // len(tails), key % len(tails)
        norm = K1 * (1 - B + B * self.size[doc] / max(1.0, average))
        self.weight = (idf[term] * count * (K1 + 1) / (count + norm)).astype(np.float32)
        self.docs = doc
        self.bounds = np.searchsorted(term, np.arange(len(idf) + 1))
        order = np.lexsort((idf[term] * -1, doc))
        ends = np.searchsorted(doc[order], np.arange(len(tails) + 1))
        self.queries = [term[order[ends[i] : ends[i] + min(QUERY_TERMS, ends[i + 1] - ends[i])]] for i in range(len(tails))]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term, best BM25 score first, ties by place."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in self.queries[seed]]
        docs = np.concatenate([self.docs[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), len(self.tails))
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def pack(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Pieces (document, ids before it in the tail, length, sequence, offset). The longest unused document is
        the seed; neighbours go in whole, the last one is cut to fill the window and its rest stays unused. When no
        neighbour is left, the next unused documents follow. Only a shard's last window can be short; it is cut into
        sequences of powers of two, which need no padding."""
        held: list[tuple[int, int, int, int, int]] = []
        for piece in self._fill():
            if held and piece[3] != held[-1][3]:
                yield from held
                held = []
            held.append(piece)
        total = sum(p[2] for p in held)
        if total == LENGTH:
            yield from held
            return
        ends, sequence = [], held[-1][3] if held else 0
        for bit in reversed(range(LENGTH.bit_length())):
            if total >> bit & 1:
                ends.append((ends[-1] if ends else 0) + (1 << bit))
        k = 0
        for doc, before, n, _, offset in held:
            while n:
                take = min(n, ends[k] - offset)
                yield doc, before, take, sequence + k, offset - (ends[k - 1] if k else 0)
                before, n, offset = before + take, n - take, offset + take
                k += offset == ends[k]

    def _fill(self) -> Iterator[tuple[int, int, int, int, int]]:
        left, taken = self.size.copy(), np.zeros(len(self.tails), np.int64)
        used = np.zeros(len(self.tails), bool)
        order, at, sequence = np.argsort(-self.size, kind="stable"), 0, 0
        partly: list[int] = []
        while True:
            while at < len(order) and used[order[at]]:
                at += 1
            seed = partly.pop() if partly else int(order[at]) if at < len(order) else None
            if seed is None:
                return
            room, offset = LENGTH, 0
            queue, k, nxt = None, 0, seed
            while nxt is not None:
                n = int(min(room, left[nxt]))
                yield nxt, int(taken[nxt]), n, sequence, offset
                taken[nxt] += n
                left[nxt] -= n
                used[nxt] = True
                room, offset = room - n, offset + n
                if left[nxt]:
                    partly.append(nxt)
                if not room:
                    break
                if queue is None:
                    queue = self.neighbours(seed, used)
                while k < len(queue) and used[queue[k]]:
                    k += 1
                if k < len(queue):
                    nxt = int(queue[k])
                elif partly:
                    nxt = partly.pop()
                else:
                    while at < len(order) and used[order[at]]:
                        at += 1
                    nxt = int(order[at]) if at < len(order) else None
            sequence += 1


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: every id of every document in one piece.

    A document's ids are those of its text and the end id 0. Whole windows of LENGTH ids are sequences by
    themselves; the tails are packed. Document frequencies are counted over all tails; the index is dealt into
    shards of up to SHARD tails along a lexical key, so that neighbours meet and a hot term is spread over many
    shards. What is left at a shard's end is cut into sequences of powers of two, so nothing is padded. Null texts count as empty (the end id alone). Rows that
    repeat an id are documents of their own; null ids pass through; other columns aren't read; an empty table gives
    an empty result. Sequence ids are even for whole windows and odd for packed ones.
    """
    place = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    terms = encoder(place).size
    kind_of_id = _type(terms)
    coded = saved(_encode(docs, place))
    tails = coded.filter("tail IS NOT NULL").select("doc_id", "start", "doc_tokens", "tail", "term", "row")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, total = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            for t in b.column(0).to_pylist():
                ids = np.frombuffer(t, kind_of_id)
                seen[np.unique(ids)] += 1
                n, total = n + 1, total + len(ids)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(seen[at], [n, total]))], names=["term", "n"])

    stats = tails.select("tail").mapInArrow(count_terms, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {r["term"]: r["n"] for r in stats.collect()}  # at most one row for each id of the vocabulary
    count, total = frequency.pop(-1, 0), frequency.pop(-2, 0)
    df = np.zeros(terms)
    df[list(frequency)] = list(frequency.values())
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32))
    average = total / max(1, count)
    least = shuffle_partitions(docs.sparkSession)
    parts = min(max(least, -(-count // SHARD)), MOST_PARTS * least)  # a task fills one shard after another

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal base
            shard = Shard([np.frombuffer(r[3], kind_of_id) for r in rows], idf.value, average)
            out, last = [], -1
            for i, before, n, sequence, offset in shard.pack():
                doc, start, total, _ = rows[i]
                out.append((doc, start + before, n, _crc(shard.tails[i][before : before + n]), total, 2 * ((part << 40) + base + sequence) + 1, offset))
                last = sequence
            base += last + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (types[0], *[pa.int64()] * 6), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        for b in batches:
            types = [b.schema.field(0).type]
            rows += zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)
            while len(rows) >= 2 * SHARD:  # what stays makes a full shard too
                yield packed(rows[:SHARD])
                rows = rows[SHARD:]
        if rows:
            yield packed(rows)

    dealt = tails.repartitionByRange(parts, "term", F.xxhash64("row")).sortWithinPartitions("term", "row").select("doc_id", "start", "doc_tokens", "tail")
    whole = coded.filter("tail IS NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.union(dealt.mapInArrow(run, PIECE.format(kind=kind)))


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
