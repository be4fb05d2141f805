"""Token ids in Arrow files: sequences of equal length and their masks as fixed-size lists, read in place.

The ids of all documents, in ascending order of doc_id, are one long row of numbers that is cut into shards. A shard is two
Arrow files. One has record batches of ``ROWS`` sequences of ``LENGTH`` ids (``ids``) and whether each is a real id
(``mask``); only the end of a shard is padded, so sequence i is in batch i // ROWS and is a view of the mapped file. The
other has doc_id, start in the shard, and n_tokens of each document. A manifest table names the shards, in order, with the
ids before each; it is written when all shards are, so a shard that a lost task has left half written is never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.shared import new_path, storage, written

#: Ids of a sequence, and sequences of a record batch.
LENGTH, ROWS = 2048, 256
#: Words whose ids a task keeps, and characters that are cut into words at once.
WORDS, STRETCH = 800_000, 1 << 20
#: Texts that are not folded here: letters whose folding may depend on others, and what may begin a special token.
BEYOND_LATIN = re.compile("[^\\x00-\u012f\u0131-\u017f]|<[|]")
END_MARKS = re.compile(r"(?<=[a-z0-9])[.,;:!?](?=\s)")
#: Documents of a batch of the second file.
DOCUMENTS = 1 << 15


class Encoder:
    """The ids of whole texts as the library gives them, as bytes of little-endian unsigned numbers.

    Where white space parts words for good, as the vocabulary is probed for, each distinct word is encoded once and kept,
    many new ones in a call with a mark between them. Where the vocabulary also folds case and parts marks from letters,
    Latin texts are folded and parted before, so that fewer words are distinct. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        a, b = self._plain("ab"), self._plain("cd")
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.parting = [c for c in spaces if self._plain(f"ab{c}{c}cd{c}") == a + b and not self._plain(c)]
        self.by_word = " " in self.parting
        self.at_spaces = re.compile(f"[{re.escape(''.join(self.parting or ' '))}]+")
        joining = {*spaces} - {*self.parting}
        self.joining = re.compile(f"[{re.escape(''.join(joining))}]") if joining else None
        parts_marks = all(self._plain(f"ab{m} 1{m}") == a + self._plain(m) + self._plain("1") + self._plain(m) for m in ".,;:!?")
        self.folds = self.by_word and parts_marks and self._plain("ABÉÀÜ") == self._plain("abéàü")
        self.mark = next((m for m in map(chr, range(9)) if len(self._plain(m)) == 1), None)
        self.mark_id = self._plain(self.mark)[0] if self.mark else None

    def _plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _words(self, text: str) -> list[str]:
        if self.folds and not BEYOND_LATIN.search(text):
            text = END_MARKS.sub(r" \g<0>", text.lower())
        if self.joining and self.joining.search(text):
            return [w for w in self.at_spaces.split(text) if w]
        return text.split()

    def _learn(self, words: list[str]) -> None:
        """Encodes new words: those without the mark in calls of many, the others one by one."""
        easy = [w for w in words if self.mark and self.mark not in w]
        for w in {*words} - {*easy}:
            self.known[w] = self._bytes(self._plain(w))
        for at in range(0, len(easy), 2000):
            some = easy[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([f" {self.mark} ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark_id) * self.dtype.itemsize
            if len(ends) != len(some) - 1:
                raise ValueError("the mark is not apart from the words")
            data, starts = ids.tobytes(), (ends + self.dtype.itemsize).tolist()
            for w, start, end in zip(some, [0, *starts], [*ends.tolist(), len(data)], strict=True):
                self.known[w] = data[start:end]

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in parts of bounded size where it has white space."""
        if not self.by_word:
            yield self._bytes(self._plain(text))
            return
        at = 0
        while at < len(text):
            cut = self.at_spaces.search(text, at + STRETCH)
            to = cut.start() if cut else len(text)
            words = self._words(text[at:to])
            new = {*words}.difference(self.known)
            if new:
                if len(self.known) + len(new) > WORDS:
                    self.known.clear()
                    new = {*words}
                self._learn(list(new))
            yield b"".join(map(self.known.__getitem__, words))
            at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary, kept from task to task of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Writes a shard to two sinks; documents are added in order, and no more than a batch is kept."""

    def __init__(self, ids_sink, docs_sink, dtype: np.dtype, doc_type: pa.DataType, length: int = LENGTH, rows: int = ROWS):
        self.dtype, self.length, self.rows = dtype, length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = (ids_sink, docs_sink)
        self.ids, self.docs = pa.ipc.new_file(ids_sink, self.schema), pa.ipc.new_file(docs_sink, self.doc_schema)
        self.pending, self.n_tokens, self.n_docs = bytearray(), 0, 0
        self.rows_of_docs: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, parts: Iterator[bytes]) -> None:
        """A document: its id and the bytes of its ids, in parts."""
        start = self.n_tokens
        for part in parts:
            self.pending += part
            self.n_tokens += len(part) // self.dtype.itemsize
            self._write(self.length * self.rows)
        for column, value in zip(self.rows_of_docs, (doc_id, start, self.n_tokens - start), strict=True):
            column.append(value)
        self.n_docs += 1
        if len(self.rows_of_docs[0]) >= DOCUMENTS:
            self._write_docs()

    def _write(self, size: int) -> None:
        """Writes batches of ``size`` ids while there are so many."""
        wide, at = size * self.dtype.itemsize, 0
        while size and at + wide <= len(self.pending):
            self._batch(np.frombuffer(bytes(self.pending[at : at + wide]), self.dtype), size)
            at += wide
        del self.pending[:at]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _write_docs(self) -> None:
        arrays = [pa.array(c, f.type) for c, f in zip(self.rows_of_docs, self.doc_schema, strict=True)]
        self.docs.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.doc_schema))
        self.rows_of_docs = ([], [], [])

    def close(self) -> None:
        rest = np.frombuffer(bytes(self.pending), self.dtype)
        if len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
        self._write_docs()
        for x in (self.ids, self.docs, *self.sinks):
            x.close()


class Shard:
    """Reads a shard; sequences are views of the file where it is mapped."""

    def __init__(self, ids_source, docs_source):
        self.ids, self.docs = pa.ipc.open_file(ids_source), pa.ipc.open_file(docs_source)
        self.length = self.ids.schema.field("ids").type.list_size
        first = self.ids.get_batch(0).num_rows if self.ids.num_record_batches else 0
        last = self.ids.get_batch(self.ids.num_record_batches - 1).num_rows if first else 0
        self.rows, self.sequences = first, first * (self.ids.num_record_batches - 1) + last if first else 0
        self.at, self.values = -1, np.zeros(0, self.ids.schema.field("ids").type.value_type.to_pandas_dtype())

    @classmethod
    def open(cls, path: str) -> Shard:
        """A shard by the path of its first file without suffix; files on local disk are mapped, others are read by ranges."""
        fs, local = storage(path) if "://" in path else (None, path)
        if fs is None or fs.type_name == "local":
            return cls(pa.memory_map(local + ".arrow"), pa.memory_map(local + ".docs.arrow"))
        return cls(fs.open_input_file(local + ".arrow"), fs.open_input_file(local + ".docs.arrow"))

    def _batch(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.values = number, self.ids.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.values

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask of a sequence."""
        if not 0 <= i < self.sequences:
            raise IndexError(i)
        k = i % self.rows
        return self._batch(i // self.rows)[k * self.length : (k + 1) * self.length], self.ids.get_batch(i // self.rows).column("mask")[k].values

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views of one batch each."""
        wide = self.rows * self.length
        while n > 0:
            at = start % wide
            part = self._batch(start // wide)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending order of doc_id, null first, over partitions and within them.

    Rows of one doc_id are ordered by a hash of the text; so a doc_id with very many rows goes to several partitions.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["doc_id", "_hash", "_row"]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the ids of all texts, ``end`` behind each, into ``folder``; the manifest: shard, path, base, n_tokens, n_docs.

    A shard is what one task writes. A null text counts as an empty one, which is ``end`` alone; ties of doc_id are ordered
    by the text's hash; other columns go; an empty table gives an empty manifest. ``tokenizer`` is opened on the executors.
    """
    files, _ = storage(folder)
    files.create_dir(storage(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, path, writer = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}", None
        fs, local = storage(path)
        for batch in batches:
            if writer is None and batch.num_rows:
                encoder = encoder_of(tokenizer)
                last = np.array([end], encoder.dtype).tobytes()
                writer = ShardWriter(fs.open_output_stream(local + ".arrow"), fs.open_output_stream(local + ".docs.arrow"), encoder.dtype, batch.schema.field("doc_id").type, length, rows)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                writer.add(doc_id, (part for parts in (encoder.parts(text.as_py()), (last,)) for part in parts))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_tokens": writer.n_tokens, "n_docs": writer.n_docs}])

    shards = written(ordered(docs).mapInArrow(write, "shard long, path string, n_tokens long, n_docs long"), "token-shards")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"), "n_tokens", "n_docs")  # a row for each shard


def read_shards(manifest: DataFrame, doc_type: T.DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""
    schema = T.StructType([T.StructField("doc_id", doc_type or T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            shard = Shard.open(row["path"])
            for i in range(shard.docs.num_record_batches):
                docs, sums = shard.docs.get_batch(i), []
                starts = docs.column("start").to_numpy()
                for start, n in zip(starts.tolist(), docs.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    for part in shard.span(start, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + row["base"]), docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "base").repartition("path").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of ``docs``, read back from the files that it is written to.

    ``start`` is the number of ids of all documents before it in ascending order of doc_id, null first. See
    ``write_shards`` for null and empty texts and ties; very long texts are encoded whole, in stretches; repeated rows are
    documents of their own; an empty table gives an empty result.
    """
    manifest = written(write_shards(docs, tokenizer, new_path(docs.sparkSession, "token-files"), end), "token-manifest")
    return read_shards(manifest, docs.schema["doc_id"].dataType)
