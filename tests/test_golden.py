"""Rows worked out by hand from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from probatio.config import UsageLimits
from probatio.functions import text as tx
from probatio.functions.dates import parse_mention
from probatio.operators import ai_tables as ai
from probatio.operators import categorize as ca
from probatio.operators import dedup as dd
from probatio.operators import pairs as pr
from probatio.operators import patterns as pt
from probatio.operators import projections as pj
from probatio.operators import reports as rp
from probatio.operators import scans as sn
from probatio.operators import scoring as sc
from probatio.operators import timeline as tl
from probatio.plans import scored as plan
from probatio.sources import files as fs

NOTE = "The court record is false evidence; a lie. Attorney email."


def value(spark, col, **fields):
    df = spark.createDataFrame([tuple(fields.values())] if fields else [(0,)], list(fields) or ["_"])
    return df.select(col.alias("v")).first()["v"]


def file_row(spark, content=NOTE, name="note.txt", kind="Text File"):
    when = dt.datetime(2024, 3, 5)
    return spark.createDataFrame([(1, "a/" + name, name, kind, content, when, when)],
                                 "doc_id long, file_path string, file_name string, file_type string, content string, "
                                 "created_ts timestamp, modified_ts timestamp")


def test_lead_summary_keeps_inner_spaces(spark):
    assert value(spark, pj.lead_summary(F.col("c")), c="A. B. C. D") == "A.  B.  C"


def test_basic_summary(spark):
    assert value(spark, pj.short_summary(F.col("c")), c=" One\ntwo.. Three . Four. Five") == "One two. Three. Four"
    assert len(value(spark, pj.short_summary(F.col("c")), c="x" * 600 + ".")) == 500
    assert value(spark, pj.short_summary(F.col("c")), c="...") == "..."


def test_standard_name(spark):
    cols = [F.to_timestamp(F.lit("2024-03-05 00:00:00")), F.lit("04_FRAUD_ON_THE_COURT"), F.col("s"), F.lit("note.txt")]
    assert value(spark, pj.standard_name(*cols), s=NOTE) == "240305-FOTC-The_court_record_is_false.txt"
    assert value(spark, pj.standard_name(*cols), s="") == "240305-FOTC-note.txt"
    cols[1] = F.lit("elsewhere")
    assert value(spark, pj.standard_name(*cols), s="").startswith("240305-UNK-")


@pytest.mark.parametrize("size,label", [(0, "0 B"), (1024, "1.0 KB"), (1024 ** 2, "1.0 MB"), (1024 ** 3, "1.0 GB"), (1280, "1.2 KB"),
                                        (1023, "1023.0 B"), (1024 ** 5, "1024.0 TB")])
def test_size_label(spark, size, label):
    assert value(spark, pj.size_label(F.col("s")), s=size) == label


@pytest.mark.parametrize("name,safe", [("normal_file.txt", "normal_file.txt"), ("file<with>bad:chars.txt", "file_with_bad_chars.txt"),
                                       ("file/with\\path.txt", "file_with_path.txt"), ("a" * 300 + ".txt", "a" * 251 + ".txt"),
                                       ("b" * 300, "b" * 255)])
def test_safe_file_name(spark, name, safe):
    assert value(spark, pj.safe_file_name(F.col("n")), n=name) == safe


def test_folder_names(spark):
    assert value(spark, pj.safe_folder_name(F.col("n")), n="A  theory: #1 (new)") == "A_theory_1_new"
    assert value(spark, pj.safe_folder_name(F.col("n")), n="") == "Unnamed_Folder"
    assert value(spark, pj.code_of_folder(F.col("n")), n="02_FINANCIAL_EVIDENCE_2B_of_TIME") == "FEOT"


def test_extensions(spark):
    names = ["a.pdf", "b.XLSX", "c.jpg", "d.eml", "e.xyz", "noext", ".hidden"]
    df = spark.createDataFrame([(n, n) for n in names], "file_path string, file_name string")
    got = {r["file_path"]: (r["category"], r["supported"]) for r in sn.ext_category(df).collect()}
    assert got["a.pdf"] == ("documents", True) and got["b.XLSX"] == ("spreadsheets", True)
    assert got["d.eml"] == ("emails", True) and got["e.xyz"] == (None, False) and got["noext"] == (None, False)
    assert {r["file_path"] for r in sn.unsupported_files(df).collect()} == {"e.xyz", "noext", ".hidden"}


def test_hashes_fall_back_to_sha256(spark):
    df = spark.createDataFrame([("p", "test content")], "file_path string, raw string")
    row = sn.content_hashes(df, ["crc"]).first()
    assert len(row["sha256"]) == 64 and list(row.asDict()) == ["file_path", "sha256"]


def test_required_fields(spark):
    df = spark.createDataFrame([(1, "c", "s", "t"), (2, "c", None, ""), (3, "", None, "t")], "k long, case_name string, source string, target string")
    got = {r["k"]: r["missing"] for r in pj.required_fields(df, "k", ["case_name", "source", "target"]).collect()}
    assert got == {1: [], 2: ["source", "target"], 3: ["case_name", "source"]}


def test_category_and_scores(spark):
    ev = file_row(spark, "The court record is false evidence; a lie")
    got = {r["category"]: r["hits"] for r in ca.category_scores(ev).collect()}
    assert got.pop("FRAUD_ON_THE_COURT") == 3 and not any(got.values())
    row = plan.scored(file_row(spark)).first()
    assert row["predicted_category"] == "04_FRAUD_ON_THE_COURT" and row["category"] == "09_FOR_HUMAN_REVIEW"
    assert row["confidence_score"] == pytest.approx(3 / 11) and row["probative_value"] == pytest.approx(0.4)
    assert row["prejudicial_value"] == 0 and row["admissibility_score"] == pytest.approx(0.42)
    assert row["overall_impact"] == pytest.approx(0.16 + 0.3 * 3 / 11 + 0.126) and row["requires_human_review"]


def test_ties_go_to_the_first_category(spark):
    row = ca.categorize(file_row(spark, "x y"), ) .first()
    assert row["folder"] == "09_FOR_HUMAN_REVIEW" and row["category"] is None
    row = ca.categorize(file_row(spark, "x y", "n"), {"A": ["x", "q"], "B": ["y", "z"]}).first()
    assert row["category"] == "A"


def test_strength(spark):
    assert value(spark, sc.strength_col(F.col("c"), F.lit("legal")), c="the court order was filed, maybe") == pytest.approx(0.7)
    assert value(spark, sc.strength_col(F.col("c"), F.lit("x")), c="maybe might could possibly perhaps") == pytest.approx(0.1)


@pytest.mark.parametrize("raw,fmt,date", [
    ("13/02/2023", "MM/DD/YYYY", "2023-02-13"), ("02/13/2023", "MM/DD/YYYY", "2023-02-13"), ("2/30/2020", "MM/DD/YYYY", None),
    ("1/2/69", "MM/DD/YY", "2069-01-02"), ("1/2/70", "MM/DD/YY", "1970-01-02"), ("2024-2-29", "YYYY-MM-DD", "2024-02-29"),
    ("2023-2-29", "YYYY-MM-DD", None), ("Sept 3 2021", "Month DD, YYYY", "2021-09-03"), ("Foo 3, 2021", "Month DD, YYYY", None),
    ("3 March 2021", "DD Month YYYY", "2021-03-03"), ("05-06-2020", "MM-DD-YYYY", "2020-05-06")])
def test_dates(spark, raw, fmt, date):
    got = value(spark, parse_mention(F.col("r"), F.lit(fmt)), r=raw)
    assert (str(got) if got else None) == date


def test_match_positions_count_characters(spark):
    text = "élan 1/2/2020 ß und 03/04/2021, 5/6/2022"
    import re
    pattern = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    got = value(spark, tx.match_positions(F.col("t"), pattern), t=text)
    assert [(m["start"], m["raw"]) for m in got] == [(m.start(), m.group()) for m in re.finditer(pattern, text)]
    assert value(spark, tx.match_positions(F.col("t"), pattern), t="none") == []


def events(spark, dates, strength=None, kind="legal"):
    rows = [(i, i, "f", dt.date.fromisoformat(d), kind, "A", f"T{i}", (strength or [0.5] * len(dates))[i]) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "doc_id long, position long, format string, event_date date, event_type string, argument string, title string, evidence_strength double")


def test_clusters_with_gap_of_exactly_30_days(spark):
    got = tl.date_clusters(events(spark, ["2024-01-01", "2024-01-31", "2024-02-15", "2024-04-01"])).collect()
    assert [(r["events"], r["label"], r["reported"]) for r in got] == [(3, "January 2024", True)]


def test_same_day_events_are_one_cluster(spark):
    got = tl.date_clusters(events(spark, ["2024-01-01", "2024-01-01", "2024-06-01"])).collect()
    assert [(r["events"], r["reported"]) for r in got] == [(2, False)]


def test_critical_period_by_strength(spark):
    ev = events(spark, ["2024-01-01", "2024-01-09"], [0.5, 0.8])
    row = tl.critical_periods(ev).first()
    assert row["reason"].startswith("High-strength") and row["event_count"] == 2 and row["average_strength"] == pytest.approx(0.65)
    assert [r["title"] for r in tl.critical_titles(ev).collect()] == ["T1"]


def test_escalation(spark):
    assert tl.escalation(events(spark, ["2024-01-01", "2024-02-01"], [0.4, 0.6], "abuse")).first()["escalating"]
    assert tl.escalation(events(spark, ["2024-01-01"], kind="abuse")).count() == 0


def test_lexicon_confidence(spark):
    texts = spark.createDataFrame([(1, "content", "He hit, HIT and hit her and pushed; hitting éhit")], "doc_id long, source string, text string")
    row = pt.lexicon_patterns(texts).where("sub_pattern = 'physical_abuse'").first()
    assert (row["distinct_keywords"], row["total_matches"]) == (2, 4) and row["confidence"] == pytest.approx(0.9)
    assert row["title"] == "Abuse: Physical Abuse"
    other = pt.lexicon_patterns_joined(texts, fs.default_lexicon(spark)).where("sub_pattern = 'physical_abuse'").first()
    assert (other["distinct_keywords"], other["total_matches"], other["confidence"]) == (2, 4, pytest.approx(0.9))


def lexicon_of(spark, words):
    rows = [(i, "g", f"s{i % 7}", w, 0.4, 0.1, "") for i, w in enumerate(words)]
    return spark.createDataFrame(rows, fs.LEXICON_SCHEMA)


@pytest.mark.parametrize("broadcast_keywords", [0, 1000])
def test_keyword_counts_equal_the_patterns(spark, broadcast_keywords):
    import regex

    from probatio.functions.text import whole_word
    words = ["no", "no no", "No No No", "so-called", "$100", "c++", "(a)", "Zoë", "a", "A b", "!", "x_1", "\U0001F600 x", " no"]
    texts = ["no no no no", "NO  no so-called, so-calledx $100 x$100 c++ c+++ (a) (a)b", "zoë ZOË Zoe a b a B! !! x_1 x_12", "", None,
             "\U0001F600 x\U0001F600 x no", "a" * 5000 + " a b\nno no", "no no no no"]
    df = spark.createDataFrame([(i if i < 7 else 0, "t", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = sorted((r["doc_id"], r["keyword"], r["n"]) for r in pt.keyword_counts(df, lexicon_of(spark, words + ["", "no"]), broadcast_keywords).collect())
    want = sorted((i if i < 7 else 0, w.lower(), n) for i, t in enumerate(texts) for w in words for n in [len(regex.findall(whole_word(w).replace("(?iu)", "(?i)"), t or ""))] if n)
    assert got == want


def test_few_ascii_keywords_are_counted_without_runs(spark):
    """Case is compared as lower case: the Kelvin sign is a k, the long s is no s. No run of words is opened."""
    words = ["kids", "hit", "no no", "$5", "k"]
    texts = ["KIDS \u212Aids kid\u017F kidsx xkids", "hit-HIT hits éhit hité", "no no no no", "$5 x$5 $55 $5", "\u212A k K K_", None, ""]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    out = pt.keyword_counts(df, lexicon_of(spark, words))
    assert sorted((r["doc_id"], r["keyword"], r["n"]) for r in out.collect()) == [
        (0, "kids", 2), (1, "hit", 2), (2, "no no", 2), (3, "$5", 2), (4, "k", 3)]
    assert "arrays_zip" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_large_lexicon_reads_texts_once_and_shuffles_none(spark, tmp_path):
    words = [f"k{i}" for i in range(25_000)] + [f"k{i} z{i}" for i in range(25_000)]
    rows = [(i, "t", " ".join(f"k{(i * j) % 30_000} z{(i * j) % 30_000 if j % 2 else 1}" for j in range(300))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "texts"))
    lexicon = lexicon_of(spark, words)
    known = set(words)
    want = {}
    for i, _, t in rows:
        w = t.split(" ")
        n = sum(x in known for x in w) + sum(f"{a} {b}" in known for a, b in zip(w, w[1:]))
        want[i] = n
    for broadcast_keywords in (1000, 100_000):
        out = pt.lexicon_patterns_joined(spark.read.parquet(str(tmp_path / "texts")), lexicon, broadcast_keywords)
        got = {}
        for r in out.collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["total_matches"]
        assert got == want
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        parts = plan.split("\n\n")
        assert sum("Scan parquet" in p and "text" in p for p in parts) == 1
        assert not any("Exchange" in p.split("\n")[0] and " text#" in p for p in parts)


def test_recurrence(spark):
    row = pt.recurrence_patterns(events(spark, ["2024-01-01"] * 4)).first()
    assert row["confidence"] == pytest.approx(0.85) and row["n"] == 4 and row["files"] == 4


def test_recurrence_tells_the_first_events(spark):
    dates = ["2024-03-01", "2024-01-05", "2024-02-01", "2024-01-05", "2023-12-31", "2024-06-01", "2022-01-01"]
    many = events(spark, dates).unionByName(events(spark, ["2024-01-01", "2024-01-02"], kind="rare")) \
        .unionByName(events(spark, ["2021-01-01"] * 3, kind="none").withColumn("argument", F.lit(None).cast("string")))
    got = {(r["timeline"], r["event_type"]): [(str(e["event_date"]), e["doc_id"], e["title"]) for e in r["first_events"]]
           for r in pt.recurrence_patterns(many).collect()}
    assert got == {("A", "legal"): [("2022-01-01", 6, "T6"), ("2023-12-31", 4, "T4"), ("2024-01-05", 1, "T1"), ("2024-01-05", 3, "T3"), ("2024-02-01", 2, "T2")],
                   (None, "none"): [("2021-01-01", 0, "T0"), ("2021-01-01", 1, "T1"), ("2021-01-01", 2, "T2")]}
    assert "first_events" not in pt.recurrence_patterns(many, first=0).columns


def test_merge_boost_equals_the_fold(spark):
    import random
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        conf = [round(rng.uniform(0.2, 0.9), 2) for _ in range(n)]
        want = conf[0]
        for c in conf[1:]:
            want = min(1.0, max(want, c) + 0.05)
        df = spark.createDataFrame([(i, "t", "x", c) for i, c in enumerate(conf)], "doc_id long, pattern_type string, title string, confidence double")
        row = pt.pattern_merge(df, block_size=4).first()
        assert row["boosted_confidence"] == pytest.approx(want) and row["confidence"] == max(conf)


def test_name_pairs(spark):
    def docs(n):
        return spark.createDataFrame([(i, "Ada Byron met Carl Gauss") for i in range(n)] + [(99, "Ada Byron alone")], "doc_id long, content string")
    assert pr.name_cooccurrence(docs(2)).first()["confidence"] == pytest.approx(0.6)
    row = pr.name_cooccurrence(docs(4)).first()
    assert (row["name1"], row["name2"], row["n_files"], row["confidence"]) == ("Ada Byron", "Carl Gauss", 4, 0.9)
    assert pr.name_cooccurrence(docs(1)).count() == 0


def test_folder_strength_blend(spark):
    df = spark.createDataFrame([("c", 0.8, 0.6), ("c", 0.4, 0.2)], "category string, overall_impact double, relevance_score double")
    assert rp.folder_strength(df).first()["strength"] == pytest.approx(0.52)


def test_cost(spark):
    df = spark.createDataFrame([(1, "x" * 4000)], "doc_id long, content string")
    got = {r["analysis_type"]: r["tokens"] for r in ai.cost_estimate(df).collect()}
    assert got["legal_analysis"] == 2800 and got["other"] == 2400


def usage(spark, oks, key=1):
    rows = [(key, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), ok) for i, ok in enumerate(oks)]
    return spark.createDataFrame(rows, "usage_key long, request_id long, ts timestamp, success boolean")


def test_rate_multiplier(spark):
    got = ai.rate_multiplier(usage(spark, [False, False, False, False, True])).orderBy("request_id").collect()
    assert [r["multiplier"] for r in got] == pytest.approx([1.0, 1.0, 0.7, 0.49, 0.59])


def test_backoff_rule(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1, 0, 0, i), i >= 2, 1, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "usage_key long, request_id long, ts timestamp, success boolean, tokens long, cost double")
    got = ai.backoff(df, UsageLimits(requests_per_minute=2)).orderBy("request_id").collect()
    assert [(r["request_id"], r["errors_before"], r["backoff_seconds"]) for r in got] == [(2, 2, pytest.approx(13.5)), (3, 0, 6.0)]


def test_duplicates_ignore_unreadable_files(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "c", "h"), (4, "d", "h"), (5, "e", None)], "doc_id long, file_path string, file_hash string")
    got = {r["doc_id"]: (r["is_duplicate"], r["duplicate_of"]) for r in dd.exact_duplicates(df).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (False, None), 4: (True, "c"), 5: (False, None)}


def test_scheme_priority_and_whole_words(spark):
    df = spark.createDataFrame([(1, "a.txt", "the hitman", ["X"]), (2, "bank.txt", "a hit", []), (3, "bank.txt", "none", None), (4, "b", "none", None)],
                               "doc_id long, file_name string, search_text string, tags array<string>")
    scheme = [{"folder": "LATE", "filename_keywords": ["bank"]}, {"folder": "EARLY", "priority": 1, "ai_tags": ["x"], "content_keywords": ["hit"]}]
    got = {r["doc_id"]: (r["folder"], r["reason"]) for r in ca.scheme_categorize(df, scheme).collect()}
    assert got[1] == ("EARLY", "Matched AI tag(s): x") and got[2] == ("EARLY", "Matched content keyword(s): hit")
    assert got[3] == ("LATE", "Matched filename keyword(s): bank") and got[4][0] == "FOR_HUMAN_REVIEW"


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("naïve\r\ntext".encode())
    (tmp_path / "sub" / "b.TXT").write_bytes(b"caf\xe9\n")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "m.eml").write_bytes(b"Subject: Hi\nFrom: a@b.c\n\nBody\n")
    (tmp_path / "bad.eml").write_bytes(b"Content-Type: text/plain; charset=nonsense\n\n\xff\xfe")
    scan = fs.corpus_scan(spark, str(tmp_path), with_bytes=True)
    assert {r["path"].split("/")[-1] for r in scan.select("path").collect()} == {"a.txt", "b.TXT", "m.eml", "bad.eml"}
    got = {r["path"].split("/")[-1]: r for r in fs.text_decode(scan.where("extension = '.txt'")).collect()}
    assert (got["a.txt"]["content"], got["a.txt"]["encoding_used"], got["a.txt"]["line_count"]) == ("naïve\ntext", "utf-8", 2)
    assert (got["b.TXT"]["content"], got["b.TXT"]["encoding_used"], got["b.TXT"]["line_count"]) == ("café\n", "latin-1", 2)
    empty = spark.createDataFrame([("e", bytearray())], "path string, content binary")
    assert fs.text_decode(empty).first()["line_count"] == 1
    mails = {r["path"].split("/")[-1]: r for r in fs.email_extract(scan.where("extension = '.eml'")).collect()}
    assert (mails["m.eml"]["subject"], mails["m.eml"]["recipient"], mails["m.eml"]["body"]) == ("Hi", "Unknown Recipient", "Body\n")
    assert mails["bad.eml"]["error"]


def test_merged_patterns_count_files(spark):
    """File 1 shows a pattern in two texts, file 2 in one: two files, three patterns."""
    from probatio.operators import patterns as pt

    rows = [(1, "g", "T", 0.5), (1, "g", "T", 0.7), (2, "g", "T", 0.6), (3, "g", "U", 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, pattern_type string, title string, confidence double")
    got = {r["title"]: r for r in pt.pattern_merge(df).collect()}
    assert (got["T"]["merged"], got["T"]["confidence"], got["T"]["first_file"]) == (2, 0.7, 1)
    # in order 0.5, then max(0.5, 0.7) + 0.05, then max(0.75, 0.6) + 0.05
    assert got["T"]["boosted_confidence"] == pytest.approx(0.8) and (got["U"]["merged"], got["U"]["boosted_confidence"]) == (1, 0.9)
    files = {(r["pattern_id"], r["doc_id"]): (r["patterns"], r["confidence"]) for r in pt.pattern_files(df).collect()}
    assert files[(got["T"]["pattern_id"], 1)] == (2, 0.7) and len(files) == 3
    events = spark.createDataFrame([(1, "2024-01-02", "legal"), (1, "2024-01-02", "legal"), (2, "2024-01-02", "legal"), (2, "2024-03-01", "other"),
                                    (9, "2024-01-02", "legal")], "doc_id long, event_date string, event_type string")
    told = {(r["event_date"], r["event_type"]): (r["files"], r["first_file"]) for r in pt.pattern_events(df, events).collect()}
    assert told == {("2024-01-02", "legal"): (2, 1), ("2024-03-01", "other"): (1, 2)}


def test_matches_of_a_pattern_are_rows(spark):
    from probatio.operators import patterns as pt

    lexicon = [("money", "cash_flow", 0.1, "", 0.5, ["cash", "bank transfer"])]
    texts = spark.createDataFrame([(1, "content", "Cash, cash and a bank transfer; cashier"), (1, "summary", "no money"), (2, "content", "BANK TRANSFER")],
                                  "doc_id long, source string, text string")
    got = {(r["doc_id"], r["source"], r["keyword"]): (r["matches"], r["first_place"]) for r in pt.pattern_matches(texts, lexicon).collect()}
    assert got == {(1, "content", "cash"): (2, 1), (1, "content", "bank transfer"): (1, 18), (2, "content", "bank transfer"): (1, 1)}


def test_custody_runs(spark, tmp_path):
    from probatio.operators import custody
    from probatio.sources import sinks

    def run(day, files):
        ev = spark.createDataFrame([(p, t, len(t)) for p, t in files.items()], "file_path string, raw string, file_size long") \
            .withColumn("modified_ts", F.lit("2024-01-01").cast("timestamp"))
        sinks.append_custody(ev, F.lit(day), f"{tmp_path}/ledger")

    run("d1", {"a": "1", "b": "1", "c": "1"})
    run("d2", {"a": "1", "b": "wrong"})
    run("d2", {"a": "1", "b": "2"})  # the same run again replaces itself
    run("d3", {"a": "1", "b": "2", "c": "1", "d": "1"})
    run("d4", {"a": "1"})
    ledger = sinks.read_custody(spark, f"{tmp_path}/ledger")
    assert ledger.count() == 10
    got = {(r["run_ts"], r["rel_path"]): r["change"] for r in custody.custody_changes(ledger).collect()}
    same, new, gone = "unchanged", "added", "missing"
    assert got == {("d1", "a"): new, ("d1", "b"): new, ("d1", "c"): new, ("d2", "a"): same, ("d2", "b"): "modified", ("d2", "c"): gone,
                   ("d3", "a"): same, ("d3", "b"): same, ("d3", "c"): new, ("d3", "d"): new,
                   ("d4", "a"): same, ("d4", "b"): gone, ("d4", "c"): gone, ("d4", "d"): gone}
    assert {r["rel_path"]: r["change"] for r in custody.custody_compare(ledger, "d1", "d3").collect()} == {"a": same, "b": "modified", "c": same, "d": new}
    assert {r["rel_path"]: r["run_ts"] for r in custody.custody_latest(ledger).collect()} == {"a": "d4", "b": "d3", "c": "d3", "d": "d3"}
