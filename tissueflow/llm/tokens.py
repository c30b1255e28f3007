"""Byte-pair token ids: encoding with tables of known words, and a Parquet file format for id lists."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shared_dir, shuffle_partitions, table

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Pieces and token groups that a worker keeps at most (some 150 bytes each); beyond that the ones met least go.
PIECES, GROUPS = 900_000, 600_000
#: The same beside a sort and writers of files, which need memory of their own.
PIECES_BESIDE, GROUPS_BESIDE = 600_000, 400_000
#: A single space between other characters always begins a token of its own, so the text may be cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")
#: Marks a text's first piece, which no space precedes, and the end of a text: neither occurs in valid text.
FIRST, LAST = "\ud800", "\ud801"

#: A piece of one word, marks and at most the first word of a next line: each part is a token group of its own.
MARKS = ".,!?;:#$%&*|"
PLAIN = re.compile(r"([^\W\d_]+)([.,!?;:#$%&*|]*)(?:(\n)([^\W\d_]*))?")
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and on.
_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _kept)}
#: What a vocabulary file must say for its texts to be cut at single spaces and its words encoded alone.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}

_made: dict[tuple[str, int, int], Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places(dict):
    """Each string's place, the next free one for a string not met before, which is also listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        self.new.append(key)
        return place


class Table:
    """Ids of strings. ``make(strings)`` gives (ids, number of ids of each) of strings that aren't known."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.places = _Places()
        self.size, self.at = 0, 0
        self.flat = np.zeros(1 << 12, np.uint32)
        self.start, self.count, self.used = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All keys' ids in a row, and the number of ids of each key."""
        if len(self.places) > self.most:
            self._forget()
        place = np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))
        if self.places.new:
            new, self.places.new = self.places.new, []
            self._add(*self.make(new))
        self.used[: self.size] += np.bincount(place, minlength=self.size)
        return _gathered(self.flat, self.start[place], self.count[place]), self.count[place]

    def _add(self, ids: np.ndarray, count: np.ndarray) -> None:
        size, at = self.size + len(count), self.at + len(ids)
        self.flat = _grown(self.flat, at)
        self.start, self.count, self.used = (_grown(x, size) for x in (self.start, self.count, self.used))
        self.flat[self.at : at] = ids
        self.start[self.size : size] = self.at + np.cumsum(count) - count
        self.count[self.size : size], self.used[self.size : size] = count, 0
        self.size, self.at = size, at

    def _forget(self) -> None:
        """Keep what was met more than once, at most half of ``most``, and halve the counts."""
        used = self.used[: self.size]
        least = max(2, int(np.partition(used, -self.most // 2)[-self.most // 2]) + 1)
        keep = np.flatnonzero(used >= least)
        kept, old = keep.tolist(), list(self.places)
        ids, count, used = _gathered(self.flat, self.start[keep], self.count[keep]), self.count[keep], used[keep] // 2
        self.places = _Places()
        self.places.update((old[i], k) for k, i in enumerate(kept))
        self.size = self.at = 0
        self._add(ids, count)
        self.used[: self.size] = used


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start:start+count], one after another."""
    ends = np.cumsum(count)
    return flat[np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """``encode(texts)`` gives the ids of all texts, each followed by END, and where each text's end: the same ids as
    the tokenizer's own.

    The text is cut where the tokenizer cuts anyway; each distinct piece is encoded once, by the tokenizer or, for
    plain words, by its model. For vocabularies of another kind than byte-level pairs every text is a piece.
    """

    def __init__(self, path: str, pieces: int = PIECES, groups: int = GROUPS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        level, model = says.get("pre_tokenizer") or {}, says["model"]
        self.cuts = not says.get("normalizer") and not says.get("post_processor") and BYTE_LEVEL.items() <= level.items() and all(model.get(k) == v for k, v in PLAIN_MODEL.items() if v or model.get(k))
        self.cuts = self.cuts and not any(" " in t["content"] for t in says.get("added_tokens", ()))
        self.size = self.tokenizer.get_vocab_size()
        self.pieces, self.groups = Table(self._pieces, pieces), Table(self._groups, groups)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, ends = [], []
        for text in texts:
            if text:
                words = [text] if not self.cuts else CUT.split(text) if RUN.search(text) else text.split(" ")
                words[0] = FIRST + words[0]
                keys += words
            keys.append(LAST)
            ends.append(len(keys))
        ids, count = self.pieces.ids(keys)
        return ids, np.cumsum(count)[np.array(ends, np.int64) - 1] if ends else np.zeros(0, np.int64)

    def _pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, by their token groups; a group's key is the text that follows a space, or FIRST and the text."""
        groups: list[str] = []
        odd, sizes = [], []
        for p in new if self.cuts else ():
            if p.isalpha():
                groups.append(p)
                sizes.append(1)
            elif p[-1:] in MARKS and p[:-1].isalpha():
                groups += (p[:-1], FIRST + p[-1])
                sizes.append(2)
            else:
                first = p[:1] == FIRST
                m = PLAIN.fullmatch(p, first)
                if m and m[1].isalpha() and (not m[4] or m[4].isalpha()):
                    parts = [FIRST + g for g in m.groups() if g]
                    if not first:
                        parts[0] = m[1]
                    groups += parts
                    sizes.append(len(parts))
                else:
                    odd.append(p)
                    sizes.append(0)
        if not self.cuts:
            odd, sizes = new, [0] * len(new)
        ids, count = self.groups.ids(groups)
        of = np.array(sizes, np.int64)
        total = np.zeros(len(new), np.int64)
        plain = np.flatnonzero(of)
        if len(plain):
            total[plain] = np.add.reduceat(count, (np.cumsum(of) - of)[plain])
        if not odd:
            return ids, total
        found = self._tokenized([p if p == LAST else p[1:] if p[:1] == FIRST else " " + p for p in odd])
        total[of == 0] = [len(x) for x in found]
        out, from_odd = np.zeros(int(total.sum()), np.uint32), np.repeat(of == 0, total)
        out[~from_odd] = ids
        out[from_odd] = np.concatenate(found)
        return out, total

    def _tokenized(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.array([END], np.uint32) if t == LAST else None for t in texts]
        left = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(left), 4096):
            part = left[lo : lo + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _groups(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of token groups: the tokenizer's model alone, given each group's bytes in its alphabet."""
        tokenize, space = self.model.tokenize, chr(ALPHABET[32])
        plain = [space + g if g.isascii() and g.isalpha() else (g[1:] if g[0] == FIRST else " " + g).encode().decode("latin-1").translate(ALPHABET) for g in new]
        found = [[t.id for t in tokenize(g)] for g in plain]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for f in found for x in f), np.uint32, int(count.sum())), count


def encoder(path: str, pieces: int = PIECES, groups: int = GROUPS) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    key = (path, pieces, groups)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(*key)
    return _made[key]


def drop_encoders() -> None:
    """Free this worker's tables: a task that only reads ids back doesn't need them."""
    if _made:
        _made.clear()
        gc.collect()  # tables and encoder refer to each other


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, or fewer where texts are long."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, row_group_bytes: int = 8 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode ``docs(doc_id, text)`` into Parquet files in ascending doc_id order (nulls first).

    Columns: part and local_start (place of the document's first id inside its file), doc_id, n_tokens, ids
    array<int> (the text's ids, then the end id 0). Ids are dictionary encoded; the other columns are delta
    encoded (format version 2), which suits ascending numbers. Row groups and pages have the given sizes, and the
    page indexes let a reader fetch single documents (:func:`read_documents`), or metadata without ids
    (:func:`read_metadata`). A null text counts as empty; rows that repeat an id are ordered by text; an empty table
    gives files without rows.
    """
    place = vocabulary or vocabulary_path()
    parts = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(place, PIECES_BESIDE, GROUPS_BESIDE), TaskContext.get().partitionId(), 0
        for b in small_batches(batches):
            ids, ends = enc.encode(b.column(1).to_pylist())
            if not len(ends):
                continue
            sizes = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part, np.int32)), pa.array(done + ends - sizes), b.column(0), pa.array(sizes), lists], names=["part", "local_start", "doc_id", "n_tokens", "ids"])
            done += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(run, f"part int, local_start long, doc_id {kind}, n_tokens long, ids array<int>")
    options = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd"}
    writer = out.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_metadata(spark, path: str) -> DataFrame:
    """``(part, local_start, doc_id, n_tokens)`` of every document; the id lists aren't read."""
    return spark.read.parquet(path).select("part", "local_start", "doc_id", "n_tokens")


def read_documents(spark, path: str, wanted: Column) -> DataFrame:
    """``(doc_id, ids)`` of the documents where ``wanted``, a condition on doc_id, n_tokens, part or local_start, holds.

    A comparison with values is pushed to the files, whose statistics and page indexes leave only pages that can
    hold such rows to be read."""
    return spark.read.parquet(path).filter(wanted).select("doc_id", "ids")


def token_index(spark, path: str) -> DataFrame:
    """``(part, base)``: the number of ids in all files before each; one row a file, read without the id lists."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def token_digests(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, read back from its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for b in batches:
            lists = b.column(3)
            at, values = np.asarray(lists.offsets), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            crc = np.fromiter((zlib.crc32(values[4 * lo : 4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], names=["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(path)
    kind = stored.schema["doc_id"].dataType.simpleString()
    read = stored.select("part", "local_start", "doc_id", "ids").mapInArrow(run, f"part int, local_start long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return read.join(saved(token_index(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_query(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
