"""Token ids in files of fixed-width bits.

Each id takes the least bits that hold the vocabulary. A file is a run of blocks of equally many
ids, then an index: document ids, where each document starts, and the byte offset of each block.
Any range of ids is read by unpacking the blocks it touches, all with numpy. Documents are in
ascending order of id over all files; a manifest holds each file's place in that order.
"""

from __future__ import annotations

import functools
import io
import itertools
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text, package_path
from probatio.llm.words import IdTable, give_back, groups, pieces_at_blanks, tidy, worker_table
from probatio.session import fresh_path

TOKENIZER = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
#: Bytes of text whose words are looked up at once.
GROUP_BYTES = 1 << 22
MAGIC = b"IDBITS01"
#: width, ids per block, documents, ids, blocks, offset of the index
FOOTER = struct.Struct("<IIQQQQ8s")
#: Only such a blank follows no word, in Arrow's spelling.
BLANK_BEHIND_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
WORD_END = re.compile(r"(?<=\S)(?= )")


# ---- bits ------------------------------------------------------------------------------------
def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bits, ``width`` per id; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class PackedFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        self.width, self.block, n_docs, self.n_ids, n_blocks, at, magic = FOOTER.unpack(self.data[-FOOTER.size:])
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        index = np.frombuffer(self.data, "<i8", 2 * n_docs + 1 + n_blocks + 1, at)
        self.doc_ids, self.starts, self.offsets = index[:n_docs], index[n_docs:2 * n_docs + 1], index[2 * n_docs + 1:]
        self.known = np.frombuffer(self.data, np.uint8, n_docs, at + index.nbytes)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.data[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width)
                 for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of every document, some blocks at a time."""
        k, n_docs = 0, len(self.doc_ids)
        while k < n_docs:
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + 16 * self.block, "right")) - 1)
            stop = min(stop, n_docs)
            ids = self.ids(int(self.starts[k]), int(self.starts[stop]))
            for i in range(k, stop):
                a, b = int(self.starts[i] - self.starts[k]), int(self.starts[i + 1] - self.starts[k])
                yield (int(self.doc_ids[i]) if self.known[i] else None), int(self.starts[i]), ids[a:b]
            k = stop


class PackedWriter:
    """Collects whole documents and writes full blocks as they come."""

    def __init__(self, out: io.IOBase, width: int, block: int):
        self.out, self.width, self.block = out, width, block
        self.doc_ids: list[int] = []
        self.known: list[bool] = []
        self.starts, self.offsets, self.held, self.n_held = [0], [0], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held - self.n_held % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for a in range(0, n, self.block):
            packed = pack(ids[a:min(a + self.block, n)], self.width)
            self.out.write(packed)
            self.offsets.append(self.offsets[-1] + len(packed))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        self.out.write(np.array(self.doc_ids + self.starts + self.offsets, dtype="<i8").tobytes())
        self.out.write(np.array(self.known, dtype=np.uint8).tobytes())
        self.out.write(FOOTER.pack(self.width, self.block, len(self.doc_ids), self.starts[-1],
                                   len(self.offsets) - 1, self.offsets[-1], MAGIC))
        self.out.close()


# ---- tokens ----------------------------------------------------------------------------------
@functools.lru_cache(maxsize=1)
def _library(path: str):
    """(the library's tokenizer, bytes that each id stands for)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    # a byte-level vocabulary spells each byte as one character; added tokens are spelled as they are
    lengths = np.zeros(library.get_vocab_size(), np.int64)
    for token, number in library.get_vocab(with_added_tokens=False).items():
        lengths[number] = len(token)
    for number, token in library.get_added_tokens_decoder().items():
        lengths[number] = len(token.content.encode())
    return library, lengths


class WordTable(IdTable):
    """Ids of distinct words by the library. Its pattern never joins a character to a blank behind
    it, so a text splits before each blank that follows a word, and equal pieces have equal ids.
    The table is keyed by the whole piece: a blank and a word, or how a text begins.
    """

    def __init__(self, path: str, limit: int):
        self.library, self.bytes_of = _library(path)
        super().__init__(limit)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Many in one text where the next piece's blank ends each, by itself where
        the piece has no blank ahead or ends in space, which its successor would change."""
        alone = np.array([w[:1] != " " or w[-1].isspace() for w in words])
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        single = [words[k] for k in np.flatnonzero(alone)]
        joined = [words[k] for k in order[:len(words) - len(single)].tolist()]
        together = ["".join(joined[k:k + 500]) for k in range(0, len(joined), 500)]
        found, lengths = [np.array(ids, np.uint32) for ids in self._ids(together)], []
        ends = np.cumsum(pc.binary_length(pa.array(joined, pa.string())).to_numpy().astype(np.int64))
        for k, ids in enumerate(found):
            mine = ends[500 * k:500 * k + 500] - (ends[500 * k - 1] if k else 0)
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), mine, "right"), prepend=0))
        for ids in self._ids(single):
            found.append(np.array(ids, np.uint32))
            lengths.append(np.array([len(ids)]))
        return order, found, np.concatenate(lengths)

    @staticmethod
    def pieces(text: str) -> list[str]:
        first, *rest = WORD_END.split(text)
        return [first, *[p[1:] for p in rest]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text; no text is null."""
        lists = pieces_at_blanks(texts, BLANK_BEHIND_SPACE, self.pieces)
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        first = np.cumsum(counts) - counts
        behind = pc.binary_join_element_wise(pa.scalar(" ", words.dictionary.type), words.dictionary, pa.scalar("", words.dictionary.type))
        pieces = pa.concat_arrays([behind, words.take(pa.array(first)).dictionary_decode()]).dictionary_encode()
        number = self.numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        numbers = number[words.indices.to_numpy()]
        numbers[first] = number[len(behind):]
        return np.split(self.gather(numbers), np.cumsum(self.sizes(numbers, counts))[:-1])


# ---- Spark -----------------------------------------------------------------------------------
def write_ids(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
              file_ids: int = FILE_IDS, table_limit: int = 450_000) -> tuple[str, DataFrame]:
    """(folder, manifest). Encodes every whole text, adds ``end_id`` and writes ids in ascending
    order of document id; a null text has only the end id, null ids come first, rows of one id
    follow each other.

    Texts are shuffled once, into ranges of ids. Each task streams its range into files of about
    ``file_ids`` ids under temporary names and renames them when whole, so a repeated task leaves
    the same files. The folder must be one that all executors reach; by default a new one in the
    shared folder. The manifest has one row per file, and is made by the driver.
    """
    path = tokenizer or package_path(TOKENIZER)
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    from tokenizers import Tokenizer

    width = max(1, (max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(WordTable, path, table_limit)
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store.create_dir(root)
        rows: list[tuple[int, int, str, int, int]] = []
        writer: PackedWriter | None = None

        def finish() -> None:
            writer.close()
            name = f"part-{part:06d}-{len(rows):04d}.bin"
            store.move(f"{root}/_{part}-{attempt}-{len(rows)}", f"{root}/{name}")
            rows.append((part, len(rows), name, len(writer.doc_ids), writer.starts[-1]))

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in groups(pc.binary_length(texts).to_pylist(), GROUP_BYTES):
                for doc_id, ids in zip(doc_ids[a:b], table.encode(texts.slice(a, b - a)), strict=True):
                    if writer is None:
                        writer = PackedWriter(store.open_output_stream(f"{root}/_{part}-{attempt}-{len(rows)}"), width, block_ids)
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    if writer.starts[-1] >= file_ids:
                        finish()
                        writer = None
            give_back()
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "no", "file", "n_docs", "n_ids"), map(list, zip(*rows, strict=True)), strict=True))
                                         if rows else {c: [] for c in ("part", "no", "file", "n_docs", "n_ids")}, schema=pa.schema(
            [("part", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # by text among equal ids, so that a task run again gives every document the same start
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # a row per file, so the driver places the files: written by Spark, each row would be a file of its own with a checksum file and a folder
    files = ordered.mapInArrow(tidy(run), "part int, no int, file string, n_docs long, n_ids long").toArrow().sort_by([("part", "ascending"), ("no", "ascending")])
    n_ids = files.column("n_ids").to_numpy()
    return folder, spark.createDataFrame(files.append_column("first_id", pa.array(np.cumsum(n_ids) - n_ids, pa.int64())))


def map_documents(spark: SparkSession, folder: str, manifest: DataFrame,
                  body: Callable[[int | None, int, np.ndarray], tuple], schema: str, names: list[str]) -> DataFrame:
    """``body(doc_id, start, ids)`` for every document in the files, ``start`` counted over all."""
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/part-*.bin") \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    placed = files.join(F.broadcast(manifest.select("file", "first_id")), "file").select("first_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column("first_id").to_pylist(), batch.column("content"), strict=True):
                documents = PackedFile(content.as_buffer()).documents()
                while rows := [body(d, first + at, ids) for d, at, ids in itertools.islice(documents, 2000)]:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names=names)

    return placed.mapInArrow(tidy(run), schema)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document."""
    return map_documents(spark, folder, manifest, lambda d, at, ids: (d, at, ids.astype(np.int32)),
                         "doc_id long, start long, ids array<int>", ["doc_id", "start", "ids"])


def checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return map_documents(spark, folder, manifest, lambda d, at, ids: (d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
                         "doc_id long, start long, n_tokens long, ids_crc32 long", ["doc_id", "start", "n_tokens", "ids_crc32"])
