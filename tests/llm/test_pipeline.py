"""The pipeline against its plain version, and the registered queries on the smallest sample."""

import random

import brute
import duckdb
import pytest
from cases import sentence

import __spark_entry__ as entry
import corpus_pipeline
from probatio.llm import benchmark_windows, jaccard_join, quality_lines, queries, secret_ledger
from probatio.llm.common import package_path, sentencepiece_model
from probatio.llm.quality_lines import LineRules


def test_pipeline(spark, small):
    con = duckdb.connect()
    load = lambda t, c: con.execute(f"SELECT {c} FROM read_parquet('{small}/{t}.parquet') ORDER BY 1").fetchall()
    rows = load("documents", "doc_id, text, source")
    judged = brute.quality(rows, LineRules())
    rows = [r for r, q in zip(rows, judged, strict=True) if q[-1]]
    rows = [r for r, c in zip(rows, brute.components([r[:2] for r in rows]), strict=True) if r[0] == c[2]]
    rows = [r for r, h in zip(rows, brute.item_hits([r[:2] for r in rows], load("benchmark", "item_id, text")), strict=True) if not h[-1]]
    sp = sentencepiece_model(package_path("piece_bpe_32k.model"))
    want = {}
    for d, t, _ in rows:
        ids = sp.encode(brute.redacted(t))
        want[d] = (len(ids), ids, brute.sha(sp.decode(ids)))
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < len(judged)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_whole_table(spark, small, name):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert queries.QUERIES[name](spark, small).count() == n


CLASHING = ["row", "id", "key", "_id", "_key", "_text", "_text_key", "_blob", "blob", "path", "_path", "_found", "_cuts", "_kept", "_told", "_bad",
            "_common", "common", "_dirty", "row_key", "doc id.x"]


def test_columns_of_the_caller_keep_their_values(spark, rows, items):
    """Names that the stages use themselves come back as they went in, through each stage and all of them in a row."""
    plain = [(d, t, s, *[f"{k}:{c}" for c in CLASHING]) for k, (d, t, s) in enumerate(rows)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(plain, schema).repartition(4)
    rules = LineRules(min_documents=2, host_percent=1)
    stages = [lambda d: quality_lines.clean_good(d, rules), lambda d: quality_lines.keep_good(d, rules), jaccard_join.keep_one,
              lambda d: benchmark_windows.keep_clean(d, items), secret_ledger.redact]
    bare = docs.select("doc_id", "text", "source")
    chained = docs
    for stage in stages:
        for given in (docs, chained):
            out = stage(given)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(r[c] == f"{r['row'].split(':')[0]}:{c}" for r in got for c in CLASHING) and got
            assert all((r.doc_id, r.source) == (rows[int(r["row"].split(":")[0])][0], rows[int(r["row"].split(":")[0])][2]) for r in got)
            if given is docs:
                assert sorted(map(repr, ((r.doc_id, r.text, r.source) for r in got))) == sorted(repr(tuple(r)) for r in stage(bare).collect())
        chained = spark.createDataFrame(got, docs.schema)


def test_boilerplate_lines_leave_the_pipeline(spark, tmp_path):
    """Planted lines of a host go in the first stage, and what is left meets the other stages."""
    rng = random.Random(12)
    line = "Subscribe to our letter and never miss a day again"
    rows = [(i, "\n".join([sentence(rng, 70), line, sentence(rng, 40)]), "hot" if i % 3 else "small") for i in range(120)]
    rows += [(500 + i, sentence(rng, 80) + "\n" + line, "other") for i in range(5)] + [(700, None, "hot"), (701, "", None), rows[4], rows[4]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never seen words in this place at all not once nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sp = sentencepiece_model(package_path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {}
    for (d, t, _), q in zip(rows, brute.quality(rows, LineRules()), strict=True):
        if q[-1]:
            want[d] = sp.encode(t if d >= 500 else t.replace("\n" + line, ""))
    assert got == want and len(want) == 125
