"""Tables of distinct words: the library sees a word once, and Python a group's distinct words only."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from probatio import session
from probatio.llm import packed_ids, piece_chunks, words
from probatio.llm.common import package_path, sentencepiece_model
from probatio.llm.words import IdTable, pieces_at_blanks

TEXTS = ["", " ", "  ", "a b a", " a b", "a  b", "a b ", "a\n b", "a \nb", "a  b", "a  b c", "x\x1f y", "ä b\t", "▁a b▁", "\n\n", "a\n\nb"]


class Spelled(IdTable):
    def __init__(self, limit):
        super().__init__(limit)
        self.asked = []

    def _encoded(self, words):
        self.asked += words
        return np.arange(len(words))[::-1], [np.frombuffer("".join(words[::-1]).encode(), np.uint8)], np.array([len(w) for w in words[::-1]], np.int64)


def test_ids_survive_what_is_forgotten():
    table = Spelled(4)
    for words in (["ab", "c"], ["ab", "ddd"], ["e", "f", "ab"], ["c", "g", "hh", "iii", "ab"], ["ab"]):
        numbers = table.numbers(words)
        assert bytes(table.gather(numbers).astype(np.uint8)).decode() == "".join(words)
        assert table.sizes(numbers, np.array([len(words) - 1, 0, 1])).tolist() == [sum(map(len, words[:-1])), 0, len(words[-1])]
    assert table.asked.count("ab") == 1


@pytest.mark.parametrize("kind,unusual", [(packed_ids.WordTable, packed_ids.BLANK_BEHIND_SPACE), (piece_chunks.ChunkTable, piece_chunks.UNUSUAL)])
def test_pieces_of_plain_and_unusual_texts(kind, unusual):
    got = pieces_at_blanks(pa.array(TEXTS), unusual, kind.pieces).to_pylist()
    for text, pieces in zip(TEXTS, got, strict=True):
        if kind is piece_chunks.ChunkTable or not text.startswith(" "):  # a blank at the start is a first piece of no ids
            assert pieces == kind.pieces(text)


class Counted:
    def __init__(self, sp):
        self.sp, self.encoded, self.decoded = sp, [], []

    def encode(self, texts, num_threads):
        self.encoded.append(texts)
        return self.sp.encode(texts, num_threads=num_threads)

    def decode(self, ids, num_threads):
        self.decoded.append(ids)
        return self.sp.decode(ids, num_threads=num_threads)

    def piece_to_id(self, piece):
        return self.sp.piece_to_id(piece)


def test_chunks_of_a_group_are_asked_for_at_once():
    path = package_path(piece_chunks.MODEL)
    sp = sentencepiece_model(path)
    table, back = piece_chunks.ChunkTable(path, 1000), piece_chunks.TextTable(path, 1000)
    table.sp = back.sp = counted = Counted(sp)
    for _ in range(2):
        ids, sizes = table.encode(pa.array(TEXTS * 3))
        want = [sp.encode(t) for t in TEXTS * 3]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert back.decode(ids, sizes).to_pylist() == [sp.decode(w) for w in want]
    assert len(counted.encoded) == len(counted.decoded) == 1
    assert len(set(counted.encoded[0])) == len(counted.encoded[0])


def test_library_ids_of_odd_texts():
    path = package_path(packed_ids.TOKENIZER)
    table = packed_ids.WordTable(path, 8)
    for texts in (TEXTS, TEXTS[::-1]):
        got = [x.tolist() for x in table.encode(pa.array(texts))]
        assert got == [table.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_a_table_take_little_memory():
    table = Spelled(200_000)
    words = [f"{k:07d}" for k in range(100_000)]
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    numbers = table.numbers(pa.array(words))
    table.asked.clear()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * len(words)  # ids, lengths, starts and uses, and the letters; as keys of a dictionary the words took twice that alone
    assert bytes(table.gather(numbers[-2:]).astype(np.uint8)).decode() == "00999980099999"


def test_a_task_gives_memory_back_after_its_last_batch(monkeypatch):
    done = []
    monkeypatch.setattr(words, "give_back", lambda: done.append(len(done)))
    got = []
    for x in words.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        assert not done
        got.append(x)
    assert got == [2, 3] and done == [0]
    monkeypatch.undo()
    words.give_back()


def test_files_of_ids_are_placed_without_files_of_their_own(spark, docs, monkeypatch):
    def none(*_):
        raise AssertionError("the manifest is not written")

    monkeypatch.setattr(session, "written", none)
    monkeypatch.setattr(packed_ids, "written", none, raising=False)
    _, manifest = packed_ids.write_ids(docs.repartition(3), file_ids=50)
    rows = manifest.orderBy("first_id", "part", "no").collect()
    assert [r.first_id for r in rows] == np.cumsum([0] + [r.n_ids for r in rows])[:-1].tolist()
    assert sum(r.n_docs for r in rows) == docs.count()
