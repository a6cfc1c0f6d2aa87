"""Balanced building blocks and pair operators against brute force, with one hot key."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.config import UsageLimits
from probatio.operators import ai_tables as ai
from probatio.operators import components
from probatio.operators import dedup as dd
from probatio.operators import pairs as pr
from probatio.operators import scans
from probatio.operators import timeline as tl
from probatio.operators.components import connected_components
from probatio.operators.skew import attach_by_key, blocked_row_number, top_per_key
from probatio.plans import q_patterns
from probatio.plans import scored as plan
from probatio.session import written
from probatio.sources.evidence import evidence


def hot_keys(n=300):
    return [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_attach(spark, heavy):
    df = spark.createDataFrame(hot_keys(), "id long, k string")
    per_key = df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = {r["id"]: r["first"] for r in attach_by_key(df, per_key, "k", "n", "id", heavy).collect()}
    first = {}
    for i, k in hot_keys():
        if k is not None:
            first.setdefault(k, i)
    assert got == {i: first.get(k) for i, k in hot_keys()}


def test_row_numbers_across_blocks(spark):
    df = spark.createDataFrame([r for r in hot_keys() if r[1]], "id long, k string").repartition(5)
    got = {r["id"]: r["row_no"] for r in blocked_row_number(df, ["k"], "id", F.floor(F.col("id") / 16)).collect()}
    seen, want = {}, {}
    for i, k in hot_keys():
        if k:
            want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_top_per_key(spark):
    df = spark.createDataFrame([(i, k, (i * 37) % 101) for i, k in hot_keys() if k], "id long, k string, v long")
    got = {(r["k"], r["rank"]): r["id"] for r in top_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 5, "id", salts=4).collect()}
    want = {}
    for k in {k for _, k in hot_keys() if k}:
        rows = sorted(((-((i * 37) % 101), i) for i, kk in hot_keys() if kk == k))[:5]
        want.update({(k, n + 1): i for n, (_, i) in enumerate(rows)})
    assert got == want


def test_many_dates_in_one_text_take_time_in_proportion(spark):
    import time

    from probatio.operators import timeline as tl
    n = 50_000
    text = "".join(f"{i:06d} on 2023-0{1 + i % 9}-1{i % 9} " + "x" * 80 + "\n" for i in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id long, content string")
    start = time.time()
    got = tl.date_mentions(rows).where("format = 'iso' OR raw_date LIKE '2023-%'").select("position", "raw_date", "context").collect()
    assert time.time() - start < 60 and len(got) >= n
    for r in got[:: 5000]:
        assert text[r.position:r.position + len(r.raw_date)] == r.raw_date
        assert r.context == text[max(0, r.position - 100):r.position + len(r.raw_date) + 100]


def test_name_conflicts_of_one_popular_name(spark):
    df = spark.createDataFrame([(i, "F", "a.b.txt") for i in range(50)], "doc_id long, folder string, file_name string")
    got = [r["unique_name"] for r in dd.name_conflicts(df, block_size=7).orderBy("doc_id").collect()]
    assert got == ["a.b.txt"] + [f"a.b_{i}.txt" for i in range(1, 50)]


def test_name_conflicts_leave_taken_names(spark):
    names = ["a.txt", "a_1.txt", "a.txt", "a.txt", "a_3.txt", "a.txt", "a_1.txt"]
    df = spark.createDataFrame([(i, "F", n) for i, n in enumerate(names)] + [(99, "G", "a.txt")], "doc_id long, folder string, file_name string")
    got = [r["unique_name"] for r in dd.name_conflicts(df, block_size=2).orderBy("doc_id").collect()]
    assert got == ["a.txt", "a_1.txt", "a_2.txt", "a_4.txt", "a_3.txt", "a_5.txt", "a_1_1.txt", "a.txt"]


@pytest.mark.parametrize("block", [3, 5000])
def test_similarity_equals_brute_force(spark, block):
    rng = random.Random(11)
    words = [f"word{i:03d}" for i in range(60)]
    docs = [(i, " ".join(["popular"] * (rng.random() < 0.7) + rng.sample(words[:25 if i % 2 else 60], rng.randint(1, 14)))) for i in range(70)]
    docs += [(100 + i, docs[0][1]) for i in range(35)]  # a third are copies
    got = pr.content_similarity(spark.createDataFrame(docs, "doc_id long, content string"), block=block).collect()
    rep = {d: d for d, _ in docs}
    rep.update({r["doc2"]: r["doc1"] for r in got if r["relation"] == "same"})
    near = {(r["doc1"], r["doc2"]): r["similarity"] for r in got if r["relation"] == "overlap"}
    assert len(near) == sum(r["relation"] == "overlap" for r in got)
    assert sum(r["relation"] == "same" for r in got) >= 35
    for (a, ta), (b, tb) in itertools.combinations(docs, 2):
        x, y = set(ta.split()), set(tb.split())
        j = len(x & y) / len(x | y)
        ra, rb = sorted((rep[a], rep[b]))
        if ra == rb:
            assert x == y
        elif j > 0.3:
            assert near[(ra, rb)] == pytest.approx(j)
        else:
            assert (ra, rb) not in near


def test_top_words_break_ties_by_first_use(spark):
    df = spark.createDataFrame([(1, "zebra apple mango zebra Élite apple other")], "doc_id long, content string")
    assert pr.top_words(df, top=3).first()["words"] == ["apple", "mango", "zebra"]


@pytest.mark.parametrize("block,threshold", [(7, 0.9), (2000, 0.6)])
def test_neighbours_equal_brute_force(spark, block, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = [(i, [float(x) for x in (centres[i % 6] + rng.normal(scale=0.4, size=8)).astype("float32")]) for i in range(90)]
    data += [(200 + i, data[0][1]) for i in range(40)]  # a third are equal
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = pr.semantic_neighbors(df, threshold, n_pivots=5, block=block).collect()
    near = {(r["id1"], r["id2"]): r["similarity"] for r in got if r["relation"] == "near"}
    assert sum(r["relation"] == "same" for r in got) == 40 and len(near) == len(got) - 40
    m = np.array([v for _, v in data[:90]], dtype="float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sim = m @ m.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if sim[i, j] >= threshold}
    assert set(near) == want and want


def test_clusters_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    got = {r["id"]: r["cluster_id"] for r in connected_components(
        spark.createDataFrame(chain + star + ring, "id1 long, id2 long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(9)}}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_hubs_are_spread_among_many_links_only(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    calls = []
    monkeypatch.setattr(components, "attach_by_key", lambda *a: calls.append(a) or attach_by_key(*a))
    links = [(5, 100 + i) for i in range(60)] + [(200 + i, 100 + i) for i in range(20)] + [(300, 301), (302, 301), (7, 7), (8, None)]
    got = {r["id"]: r["cluster_id"] for r in connected_components(spark.createDataFrame(links, "id1 long, id2 long")).collect()}
    assert got == {5: 5, **{100 + i: 5 for i in range(60)}, **{200 + i: 5 for i in range(20)}, 300: 300, 301: 300, 302: 300}
    assert bool(calls) == (few == 0)


def ledger(n=400, keys=3, seed=2):
    rng, out, t = random.Random(seed), [], dt.datetime(2024, 1, 1)
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 20, 60, 900, 3599, 3600]))
        out.append((0 if i % 3 else rng.randrange(keys), i, t, rng.random() < 0.35, rng.randrange(50), 0.5))
    return out


SCHEMA = "usage_key long, request_id long, ts timestamp, success boolean, tokens long, cost double"


def test_usage_windows_equal_brute_force(spark):
    rows = ledger()
    got = {r["request_id"]: r for r in ai.usage_windows(spark.createDataFrame(rows, SCHEMA), UsageLimits(3, 400, 1e9)).collect()}
    for k, i, t, _, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < i]
        minute = sum((t - r[2]).total_seconds() < 60 for r in before)
        tokens = sum(r[4] for r in before if (t - r[2]).total_seconds() < 3600)
        assert (got[i]["requests_60s"], got[i]["tokens_3600s"]) == (minute, tokens)
        assert got[i]["over_limit"] == (minute >= 3 or tokens >= 400)


@pytest.mark.parametrize("block", [600, 7200, 10 ** 7])
def test_rate_multiplier_equals_the_fold(spark, block):
    rows = ledger()
    got = {r["request_id"]: r for r in ai.rate_multiplier(spark.createDataFrame(rows, SCHEMA), block).collect()}
    state = {}
    for k, i, _, ok, _, _ in rows:
        m, e = state.get(k, (1.0, 0))
        if ok:
            m, e = min(1.0, m + 0.1), 0
        else:
            e += 1
            m = max(0.3, m * 0.7) if e >= 3 else m
        state[k] = (m, e)
        assert got[i]["multiplier"] == pytest.approx(m) and got[i]["consecutive_errors"] == e


@pytest.mark.parametrize("block", [2, 5, 64])
def test_rate_multiplier_in_small_blocks(spark, block):
    rows = [*ledger(700), *[(None, 5000 + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 5 == 0, 1, 0.1) for i in range(40)]]
    got = {r["request_id"]: r for r in ai.rate_multiplier(spark.createDataFrame(rows, SCHEMA), block).collect()}
    state = {}
    for k, i, _, ok, _, _ in rows:
        before, e = state.get(k, (1.0, 0))
        after = min(1.0, before + 0.1) if ok else before * 0.7 if e >= 2 else before
        state[k] = (max(0.3, after), 0 if ok else e + 1)
        assert (got[i]["multiplier_before"], got[i]["multiplier"]) == (pytest.approx(before, abs=1e-12), pytest.approx(state[k][0], abs=1e-12))
    assert len(got) == len(rows)


def test_plain_and_scaled_limits_side_by_side(spark):
    rows = ledger(300, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    limits = UsageLimits(3, 400, 12.0)
    rates = {r["request_id"]: r["multiplier_before"] for r in ai.rate_multiplier(df).collect()}
    plain = {r["request_id"]: (r["over_limit"], r["window_seconds"]) for r in ai.usage_windows(df, limits).collect()}
    for r in ai.usage_windows_scaled(df, limits).collect():
        for rate, over, window in ((1.0, r["over_limit"], r["window_seconds"]), (rates[r["request_id"]], r["over_scaled"], r["scaled_window_seconds"])):
            minute = r["requests_60s"] >= int(round(rate * 3, 9))
            hour = r["tokens_3600s"] >= int(round(rate * 400, 9)) or round(r["cost_3600s"], 9) >= round(rate * 12.0, 9)
            assert (over, window) == (minute or hour, 60 if minute else 3600 if hour else 0)
        assert plain[r["request_id"]] == (r["over_limit"], r["window_seconds"])


def test_running_totals_of_a_hot_key_and_no_key(spark):
    from probatio.operators.prefix import running

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(50), i, rng.randrange(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, i long, v long").repartition(7)
    got = {r["i"]: (r["total"], r["top"]) for r in running(df, ["k"], ["t", "i"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}).collect()}
    for k, t, i, _ in rows:
        before = [r[3] for r in rows if r[0] == k and (r[1], r[2]) < (t, i)]
        assert got[i] == (sum(before), max(before, default=None))
    assert len(got) == len(rows)


@pytest.mark.parametrize("block", [2, 3, 500])
def test_pairs_of_large_sets_as_cells(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "PAIR_BLOCK", block)
    draw = random.Random(4)
    rows = [(i, sorted(draw.sample([f"v{k:02}" for k in range(30)], draw.choice([0, 1, 2, 6, 20])))) for i in range(25)]
    rows.append((3, ["v01", "v02", "only here"]))  # a repeated id is a row of its own
    want = [(a, b, i) for i, vals in rows for a, b in itertools.combinations(vals, 2)]
    files = {}
    for a, b, _ in want:
        files[a, b] = files.get((a, b), 0) + 1
    got = pr._pair_files(spark.createDataFrame(rows, "doc_id long, vals array<string>"), 2).collect()
    assert sorted(map(tuple, got)) == sorted(w for w in want if files[w[:2]] >= 2)


@pytest.mark.parametrize("name", ["exact_duplicates", "duplicate_report", "organize_sink", "all_patterns"])
def test_texts_are_read_once(spark, small, name):
    ev, read = evidence(spark, small), spark.sparkContext.accumulator(0)
    schema, n = ev.schema, ev.count()

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = ev.mapInArrow(counted, schema)
    done = {"exact_duplicates": dd.exact_duplicates,
            "duplicate_report": lambda e: dd.duplicate_report(plan.scored_with_duplicates(e)),
            "organize_sink": lambda e: scans.organize_manifest(plan.scored_with_duplicates(e)),
            "all_patterns": lambda e: q_patterns.fact_patterns(plan.text_facts(e))}[name](seen)
    done.collect()
    assert read.value == n


def _plan(df):
    """The physical plan, whole."""
    conf = {"spark.sql.maxPlanStringLength": "10000000", "spark.sql.debug.maxToStringFields": "10000"}
    before = {k: df.sparkSession.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        df.sparkSession.conf.set(k, v)
    text = df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        df.sparkSession.conf.unset(k) if v is None else df.sparkSession.conf.set(k, v)
    return text


@pytest.mark.parametrize("name", ["date_mentions", "timeline_events"])
def test_dates_of_a_text_are_searched_once(spark, tmp_path, name):
    """No filter before the explode that would find all matches again, and no second pass for metadata."""
    text = "Hit on 01/02/2020 and filed on 3 March 2021."
    rows = [(1, "a/x.txt", "x.txt", "Text File", text, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), "abuse")]
    spark.createDataFrame(rows, "doc_id long, file_path string, file_name string, file_type string, content string, "
                          "created_ts timestamp, modified_ts timestamp, folder string").write.parquet(str(tmp_path / "ev"))
    df = getattr(tl, name)(spark.read.parquet(str(tmp_path / "ev")))
    assert _plan(df).count(lx.DATE_PATTERNS[0][1]) == 2  # the matches, and the text between them
    assert df.count() == (2 if name == "date_mentions" else 6)  # two mentions of two types each, and two of the file


def _sample(spark, folder, n=40):
    """Own tables for the evidence view: documents of which some have no order, and orders without documents."""
    spark.range(n).selectExpr("id AS doc_id", "concat('text number ', id, repeat(' word', 50)) AS text", "'en' AS lang", "'web' AS source",
                              "id AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.range(10, 3 * n).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice",
                                      "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.range(4).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_evidence_shuffles_texts_once(spark, tmp_path):
    folder, key = _sample(spark, str(tmp_path)), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        ev = evidence(spark, folder)
        plan = ev._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = {r["doc_id"]: r["party"] for r in ev.collect()}
    finally:
        spark.conf.set(key, before)
    assert sum("Exchange" in p.split("\n")[0] and " text#" in p for p in plan.split("\n\n")) == 1
    assert got == {i: f"Customer {i % 5}" if i >= 10 and i % 5 < 4 else "No party" for i in range(40)}


def test_custody_runs_join_the_evidence_once(spark, tmp_path, monkeypatch):
    from probatio.plans import q_scan_text
    folder, stored = _sample(spark, str(tmp_path)), []
    monkeypatch.setattr(q_scan_text, "written", lambda df, label: stored.append(label) or written(df, label))
    runs = q_scan_text.custody_runs(spark, folder)
    assert stored == ["inventory"]
    assert {r["run_ts"]: r["count"] for r in runs.groupBy("run_ts").count().collect()} == {"2024-01-01": 40, "2024-02-01": 34, "2024-03-01": 40}


def test_usage_windows_query_tells_both_limits(spark, tmp_path):
    rows = [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "error" if i % 3 else "buy", 20.0) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    from probatio.plans import all_queries
    got = all_queries()[0]["usage_windows"](spark, str(tmp_path)).collect()
    rates = {r["request_id"]: r["multiplier_before"] for r in all_queries()[0]["rate_multiplier"](spark, str(tmp_path)).collect()}
    assert len(got) == 40 and all(r["multiplier_before"] == pytest.approx(rates[r["request_id"]]) for r in got)
    assert all(r["over_scaled"] >= r["over_limit"] for r in got)


def test_similarity_makes_no_row_of_a_candidate(spark, monkeypatch):
    """Cells that go on over Arrow batches, blocks of cells and steps of pairs leave the pairs as they are, and no join makes candidates."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.sample([f"term{j:02d}" for j in range(40 if i % 3 else 30)], rng.randint(5, 22)))) for i in range(120)]
    sets = {d: frozenset(w for w, _ in Counter(t.split()).most_common(20)) for d, t in docs}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    monkeypatch.setattr(pr, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(pr, "WORDS_AT_ONCE", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        out = pr.content_similarity(spark.createDataFrame(docs, "doc_id long, content string"), block=16)
        got = [((r["doc1"], r["doc2"]), r["similarity"]) for r in out.where("relation = 'overlap'").collect()]
        assert len(set(sets.values())) == len(docs) and len(dict(got)) == len(got)
        assert dict(got) == pytest.approx({k: v for k, v in want.items() if v > 0.3})
        assert "array_intersect" not in _plan(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_similarity_compares_words_of_few_candidates(spark):
    """Sets that share a rare word only are told apart by their bits, before any words are compared."""
    rows = [(i, " ".join([f"shared{i // 2}", *[f"word{i}x{j}" for j in range(19)]])) for i in range(40)] + [(100, " ".join(f"again{j}" for j in range(20))), (
        101, " ".join(f"again{j}" if j < 12 else f"other{j}" for j in range(20)))]
    out = pr.content_similarity(spark.createDataFrame(rows, "doc_id long, content string"))
    assert [(r["doc1"], r["doc2"], r["n_pairs"]) for r in out.collect()] == [(100, 101, 1)]
    assert "bit_count" in _plan(out)
