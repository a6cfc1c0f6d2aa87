"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker behind another character, so a text splits
before each run of markers into chunks that are segmented independently. Each worker keeps a table
of distinct chunks: a chunk is segmented and decoded when first met, and its ids and its text are
joined back by position for every further occurrence. The table is kept from task to task; within a
group of documents Arrow finds the distinct chunks, so Python sees each of them once. A corpus-wide table would have to move every position of every text (about 1 GB for
0.5 GB of input) to save segmenting a chunk once per worker.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from probatio.llm.common import id_and_text, package_path, sentencepiece_model
from probatio.llm.words import IdTable, give_back, groups, pieces_at_blanks, worker_table

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
#: Texts that are not simply words between single blanks, in Arrow's spelling.
UNUSUAL = f"^$|^ |  |{MARK}"
MODEL = "piece_bpe_32k.model"
#: Bytes of text, and ids, that are looked up at once.
GROUP_BYTES, GROUP_IDS = 1 << 21, 1 << 19


def crossing_pieces(path: str) -> list[str]:
    """Pieces with a marker behind another character; chunking needs there to be none."""
    sp = sentencepiece_model(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return [p for p in pieces if MARK in p.lstrip(MARK)]


class ChunkTable(IdTable):
    """Distinct marked words with their ids. A chunk is named by what follows its first blank, for
    which the library puts a marker before every text it is given."""

    def __init__(self, path: str, limit: int):
        if crossing_pieces(path):
            raise ValueError(f"{path}: pieces cross whitespace markers, chunks are not independent")
        self.sp = sentencepiece_model(path)
        super().__init__(limit)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        ids = self.sp.encode(words, num_threads=1)
        if "" in words:  # a blank at the end of a text; the library gives an empty text no ids
            ids[words.index("")] = [self.sp.piece_to_id(MARK)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        return np.arange(len(words)), [flat], lengths

    @staticmethod
    def pieces(text: str) -> list[str]:
        return [c[1:] for c in CHUNK.findall(" " + text.replace(MARK, " "))] if text else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, how many each text has); no text is null."""
        lists = pieces_at_blanks(texts, UNUSUAL, self.pieces)
        chunks = lists.flatten().dictionary_encode()
        numbers = self.numbers(chunks.dictionary)[chunks.indices.to_numpy()]
        return self.gather(numbers).astype(np.int32), self.sizes(numbers, pc.list_value_length(lists).to_numpy())


class TextTable:
    """Distinct chunks of ids with their decoded text; emptied when ``limit`` is reached, which
    bounds memory and changes no result."""

    def __init__(self, path: str, limit: int):
        self.sp, self.marked, self.limit = sentencepiece_model(path), _marked(path), limit
        self.texts: dict[bytes, str] = {}

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The text of each row of ``ids``, of which a row has as many as ``sizes`` says."""
        ends = np.cumsum(sizes)
        starts = chunk_starts(ids, ends - sizes, self.marked)
        data = np.ascontiguousarray(ids, "<i4")
        offsets = np.append(starts, len(ids)).astype(np.int32) * 4
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        keys = chunks.dictionary.to_pylist()
        new = [k for k in keys if k not in self.texts]
        if len(self.texts) + len(new) > self.limit:
            self.texts.clear()
            new = keys
        found = self.sp.decode([np.frombuffer(k, "<i4").tolist() for k in new], num_threads=1) if new else []
        self.texts.update(zip(new, [" " + t for t in found], strict=True))
        words = pa.array([self.texts[k] for k in keys], pa.string()).take(chunks.indices)
        bounds = np.searchsorted(starts, np.append(0, ends)).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(bounds), words)
        return pc.utf8_slice_codeunits(pc.binary_join(rows, ""), 1)


def _marked(path: str) -> np.ndarray:
    """Per id: does its piece begin with a marker?"""
    sp = sentencepiece_model(path)
    return np.array([sp.id_to_piece(i).startswith(MARK) for i in range(sp.vocab_size())])


def chunk_starts(ids: np.ndarray, firsts: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Where chunks begin: at every marked piece, and where a row begins."""
    starts = marked[ids]
    starts[firsts[firsts < len(ids)]] = True
    return np.flatnonzero(starts)


def _encoded(table: ChunkTable, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a, b in groups(pc.binary_length(batch.column("text")).to_pylist(), GROUP_BYTES):
        part = batch.slice(a, b - a)
        ids, sizes = table.encode(part.column("text"))
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])


def _decoded(table: TextTable, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
    for a, b in groups(sizes, GROUP_IDS):
        part = batch.slice(a, b - a)
        texts = table.decode(part.column("ids").flatten().to_numpy(), np.array(sizes[a:b], np.int64))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), texts], names=["doc_id", "ids", "text"])


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           table_limit: int = 300_000) -> DataFrame:
    """(doc_id, ids array<int>): the ids the library gives for each whole text, without begin or
    end ids. One row per input row, also for repeated ones; null and empty texts have no ids.
    Narrow: no shuffle, and memory is bounded by one Arrow batch and the table."""
    path = model or package_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(ChunkTable, path, table_limit)
        for batch in batches:
            yield from _encoded(table, batch)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, table_limit: int = 200_000) -> DataFrame:
    """(doc_id, ids, text): the text the library's decode gives for each row's ids. Null ids are
    read as none, and give an empty text."""
    path = model or package_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(TextTable, path, table_limit)
        for batch in batches:
            yield from _decoded(table, batch)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text",
               table_limit: int = 300_000, text_limit: int = 200_000) -> DataFrame:
    """(doc_id, ids, text): what :func:`decode` gives for the rows of :func:`encode`, in one step. As
    two steps each task holds two Python workers at once, and as workers change places, every one of them
    ends up with both tables, also while later stages run. Memory that is no longer used goes
    back to the system after each batch."""
    path = model or package_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, back = worker_table(ChunkTable, path, table_limit), worker_table(TextTable, path, text_limit)
        for batch in batches:
            for encoded in _encoded(table, batch):
                yield from _decoded(back, encoded)
            give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")
