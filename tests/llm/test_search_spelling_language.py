"""Ranked search, spelling variants and language identification against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import ITEM_ROWS, frame

from probatio.llm import language_families, ranked_search, spelling_groups

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 11 ------------------------------------------------------------------------------------------
def ranked(rows, items, depth=50):
    docs = [(d, collections.Counter(TERM.findall(low(t)))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, words = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 50 + (50 * n * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall(low(text))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(scored[:depth], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [ranked_search.Limits(), ranked_search.Limits(5, 12, 7, 60), ranked_search.Limits(3, 10 ** 6, 10 ** 6, 10 ** 6)])
def test_ranked_search(docs, rows, items, limits):
    got = ranked_search.search(docs, items, limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked([(d, t) for d, t, _ in rows], ITEM_ROWS, limits.depth)


def test_many_equal_documents_rank_by_id(spark):
    rng = random.Random(8)
    rows = [(i, "same words in each copy here") for i in rng.sample(range(10 ** 6), 700)] + [(None, "same words in each copy here")] * 3
    rows += [(2_000_000 + i, " ".join(rng.choice("same words other filler each of it".split()) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    items = [(1, "same copy"), ("1", "EACH words, filler"), (2, "of it nowhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    got = ranked_search.search(df, asked, ranked_search.Limits(block_documents=150))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, [(str(i), t) for i, t in items])


def test_range_maxima_and_pruning():
    rng = np.random.default_rng(4)
    size, terms = 5000, 40
    held = [np.flatnonzero(rng.random(size) < (0.6 if t < 20 else 0.01)) for t in range(terms)]
    impact = np.concatenate([rng.integers(1, 50, len(h)) if t < 20 else rng.integers(500, 900, len(h)) for t, h in enumerate(held)])
    keys = np.concatenate([t * size + h for t, h in enumerate(held)])
    block = ranked_search.Block(np.arange(size), np.zeros(size, bool), keys, impact)
    for _ in range(300):
        a, b = sorted(rng.integers(0, len(held[0]) + 1, 2))
        place, value = block.largest(np.array([a]), np.array([b]))
        assert value[0] == (impact[a:b].max() if b > a else 0)
        assert a == b or place[0] == a + impact[a:b].argmax()
    weights, best = rng.integers(1, 20, terms), ranked_search.Best(10)
    scored = block.search(np.arange(terms), weights, best)
    whole = np.zeros(size, np.int64)
    for t, h in enumerate(held):
        whole[h] += impact[keys // size == t] * weights[t]
    order = np.lexsort((np.arange(size), -whole))[:10]
    assert list(best.ids) == list(order) and list(best.scores) == list(whole[order])
    assert scored < size / 2  # most intervals are dropped by their bound


# ---- 12 ------------------------------------------------------------------------------------------
def counted(rows, every, least_length, least_count):
    sums = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            sums[run] += 1
    return {w: n for w, n in sums.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def forms(vocabulary, ratio=5):
    near = {w: [x for x in vocabulary if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in vocabulary}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = top if top and vocabulary[top] >= ratio * vocabulary[w] else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], vocabulary[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def test_word_counts(docs, rows):
    pairs = [(d, t) for d, t, _ in rows]
    for every, length, count in ((0, 6, 5), (3, 6, 5), (7, 1, 1)):
        got = spelling_groups.word_counts(docs, every, length, count).collect()
        assert {r.word: r.n for r in got} == counted(pairs, every, length, count) and len(got) == len({r.word for r in got})


def vocabulary(seed=6):
    """Words in families of edits, repeated letters, one very long pair, one half that many share."""
    rng, words = random.Random(seed), {"aaaaaa": 900, "aaaaaaa": 70, "aaaaaaaa": 3, "aaaaab": 8, "baaaaa": 2, "x" * 300: 40, "x" * 299 + "y": 8, "x" * 301: 1}
    for _ in range(60):
        word = "".join(rng.choice("abcdéÿß") for _ in range(rng.randint(6, 12)))
        for n in (4000, 600, 40, 40, 5):
            words[word] = n
            k, at = rng.randrange(3), rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "q", "à"]) * (k != 0) + word[at + (k != 1):]
            word = word if len(word) >= 6 else word + "zz"
    for a in "abcdefghij":
        for b in "abcdefghij":
            words["hotstart" + a + b] = rng.choice([5, 30, 200])
    return words


@pytest.mark.parametrize("grid,tile", [(7, 4), (2000, 128)])
def test_near_pairs(spark, grid, tile):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = [(r.a, r.n_a, r.b, r.n_b) for r in spelling_groups.near_pairs(df, grid, tile).collect()]
    want = {frozenset((a, b)) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((a, b)) for a, _, b, _ in got} == want
    assert all(words[a] == x and words[b] == y for a, x, b, y in got)


def test_spelling_forms(spark):
    words = vocabulary(9)
    got = spelling_groups.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect()), key=repr) == forms(words)


def test_spelling_groups(docs, rows):
    pairs = [(d, t) for d, t, _ in rows]
    got = spelling_groups.spelling_groups(docs, 5, 3, 2, 2).collect()
    assert sorted(map(tuple, got), key=repr) == forms(counted(pairs, 5, 3, 2), 2)


# ---- 13 ------------------------------------------------------------------------------------------
SYLLABLES = {"en": "th ing ed ly er", "de": "sch ung en ei ch", "fr": "eau tion é oi ou", "es": "ción ar ñ ll os", "xx": "qwx zzk vrr"}


def sentences(lang, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))


def test_languages_held_out(spark):
    rng = random.Random(1)
    rows = [(i, sentences(lang, rng), lang, "s") for i, lang in enumerate(rng.choice(sorted(SYLLABLES)) for _ in range(900))]
    rows += [(None, "the thing", "en", "s"), (-1, None, "en", None), (-2, "", "fr", None), (-3, " 12 -- 7 ", "fr", None), (-4, "no lang thing", None, None)]
    rows += [rows[0]] * 3 + [(5000, sentences("de", rng) * 3000, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    model = language_families.train(docs, language_families.Settings(rows_per_language=120))
    assert model.families == [("germanic", ["de", "en"]), ("other", ["xx"]), ("romance", ["es", "fr"])]
    got = language_families.identify(docs, model).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r.lang_pred for r in got}
    assert [found[x] for x in (-1, -2, -3)] == ["und"] * 3 and found[-4] == "en" and found[5000] == "de"
    held = [(lang, found[i]) for i, _, lang, _ in rows[:900] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    again = language_families.identify(docs, language_families.train(docs.repartition(3), language_families.Settings(rows_per_language=120)))
    assert {r.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_held_out_rows_and_languages_do_not_reach_the_model(spark):
    rng = random.Random(2)
    rows = [(i, sentences("en" if i % 2 else "fr", rng), "en" if i % 2 else "fr") for i in range(300)]
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    one, other = (language_families.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, changed))
    assert one.families == other.families and (one.weights == other.weights).all()


def test_no_language_or_one(spark, docs, empty):
    nothing = language_families.train(empty)
    assert {(r.lang_pred, r.score) for r in language_families.identify(docs, nothing).collect()} == {("und", 0.0)}
    one = language_families.train(docs)  # all rows of the odd table are English
    assert {r.lang_pred for r in language_families.identify(docs, one).collect()} == {"en", "und"}


# ---- empty tables ----------------------------------------------------------------------------------
def test_empty_inputs(spark, empty, docs, items):
    assert ranked_search.search(empty, items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0
    assert spelling_groups.spelling_groups(empty).count() == 0
    assert language_families.identify(empty, language_families.train(frame(spark, []))).count() == 0
