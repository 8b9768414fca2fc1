"""Defined results of every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronomesh.llm import lines, mixing, packing, passages, quality, secrets, simhash, topk, toxicity, urls

#: Names that operators use inside; the stages must keep such columns.
CLASHING = "size _gone gone of copy item keys key root rep chunk cell digest whole cut _s _plan _part _weights _threshold llr line class kept first wanted bucket h p t n a b _d _c".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
OTHERS = tuple(f"other {c}" for c in CLASHING)
LONG = "und so weiter bis zum ende der langen zeile " * 3000
TEXTS = [None, "", "   \n\t ", "one", "a b c", LONG, "same text here\nsame text here", "same text here\nsame text here", "x" * 50_000, "naïve İstanbul ſ \x1c tab\tß", "\n\n\n"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"src{i % 3}", len(t or ""), *OTHERS) for i, t in enumerate(TEXTS)]
    rows += [(4, "a b c", "en", "src1", 5, *OTHERS), (None, "no id at all", *[None] * (3 + len(OTHERS))), (None, None, *[None] * (3 + len(OTHERS)))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def tables(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://Net/x?y"), (5, "http://a.net"), (6, "x" * 30_000), (6, "http://a.org/fr/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (40, []), (5, [0.25]), (None, [1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.fixture
def empty(spark, tmp_path):
    d = tmp_path / "empty"
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


OPS = [toxicity.op1_toxicity, mixing.op2_mixing, quality.op3_quality_rules, lines.op4_line_dedup, urls.op5_url_filters, secrets.op6_secret_scans, simhash.op7_simhash, topk.op8_topk_search, passages.op9_passages, packing.op10_packing]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_tables_give_no_rows(spark, empty, op):
    assert op(spark, empty).count() == 0


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_odd_rows(spark, tables, op):
    rows = op(spark, tables).collect()
    n = len(TEXTS) + 3
    if op in (toxicity.op1_toxicity, mixing.op2_mixing, quality.op3_quality_rules, secrets.op6_secret_scans, simhash.op7_simhash):
        assert len(rows) == n
    if op is toxicity.op1_toxicity:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if op is mixing.op2_mixing:
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        by_source = {}
        for r in rows:
            by_source.setdefault((r.source_size, r.target), []).append(r.taken)
        assert sum(t for (_, t) in by_source) == pytest.approx(sum(r.size for r in rows))
    if op is quality.op3_quality_rules:
        assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2, 3, 4))
        long = next(r for r in rows if r.doc_id == 5)
        assert long.n_repeat_words == long.n_words == 27_000 and long.base_failed
        assert next(r for r in rows if r.doc_id == 6).n_dup_lines == 1
    if op is lines.op4_line_dedup:
        same = [(r.doc_id, r.line_no, r.kept) for r in rows if r.doc_id in (6, 7)]
        assert sorted(same) == [(6, 0, True), (6, 1, False), (7, 0, False), (7, 1, False)]
        assert not {0, 1, 2, 10} & {r.doc_id for r in rows}
    if op is urls.op5_url_filters:
        got = [(r.page_id, r.host, r.path[:5], r.rule, r.verdict) for r in rows]
        assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got and (3, "", "", None, "allow") in got
        assert (4, "net", "/x", "net/", "block") in got and any(g[:4] == (5, "a.net", "", None) for g in got) and (6, "a.org", "/fr/1", "org/fr/", "allow") in got
        assert len(rows) == 7
    if op is simhash.op7_simhash:
        zero = [r for r in rows if r.fingerprint == "0" * 16]
        assert {r.doc_id for r in zero} == {0, 1, 2, 10, None} and {r.component_id for r in zero} == {0}
        assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    if op is topk.op8_topk_search:
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)
        best = 64 * 64 + 32 * 32
        assert got == [(0, 1, 20, best), (0, 2, 5, 1024), (0, 3, 40, 0), (20, 1, 0, best), (20, 2, 5, 1024), (20, 3, 40, 0), (40, 1, 0, 0), (40, 2, 5, 0), (40, 3, 20, 0)]
    if op is passages.op9_passages:
        assert rows == []
    if op is secrets.op6_secret_scans:
        assert all((r.n_assign, r.n_access, r.n_hex, r.spans) == (0, 0, 0, "") for r in rows)
    if op is packing.op10_packing:
        assert sum(r.length for r in rows if r.doc_id == 0) == 1 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_stages_keep_columns_and_rows(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        directory = empty
        out = stage(spark, docs, directory)
        assert out.columns == docs.columns, name
        assert all(r[c] in (None, f"other {c}") for r in out.collect() for c in CLASHING), name
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), directory).count() == 0
    cleaned = lines.stage(spark, docs, empty).where("doc_id IN (6, 7)").orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in cleaned] == [("same text here", 14), ("", 0)]
    left = simhash.stage(spark, docs, empty)
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [0, 3, 4, 5, 6, 8, 9]
    assert left.where("doc_id IS NULL").count() == 2


def test_pipeline(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, tables).columns[0] == "doc_id"


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against plain Python on what the stage before kept, and run() against the stages one by one."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    often = line(12)
    texts = ["\n".join([line(30), often] + [line(rng.randint(6, 20)) for _ in range(4)]) for _ in range(24)]
    texts += [texts[i].replace(texts[i].split()[3], word(), 1) for i in range(6)] + [line(5), " ".join([line(9)] * 20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t), *OTHERS) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(32)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, got[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        got.append(spark.read.parquet(f"{tmp_path}/{name}"))
    text = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in got[:4]]
    judged = quality.judge(got[0].select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert set(text[1]) == {r.doc_id for r in judged.where("kept").collect()} and not {30, 31} & set(text[1])
    kept, want = [], {}
    for i in sorted(text[1]):
        own = []
        for x in text[1][i].split("\n"):
            sets = set(lines.shingles(lines.normal(x.encode())).tolist())
            if all(len(sets & y) < 0.8 * len(sets | y) for y in kept):
                own.append(x)
            kept.append(sets)
        want[i] = "\n".join(own)
    assert text[2] == want
    alone, sets = set(), {}
    for i in sorted(text[2]):
        sets[i] = set(simhash.shingles(b" ".join(text[2][i].encode().lower().split())).tolist())
        if all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for j in sets if j < i):
            alone.add(i)
    assert set(text[3]) == alone
    sized = got[3].select("source", F.size(F.split("text", r"\s+")).cast("long").alias("size"))
    target = {r.source: round(r.target) for r in mixing.targets(sized, mixing.WEIGHTS, 3).collect()}
    taken = {r.source: r.n for r in got[4].groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    assert taken.keys() == target.keys() and all(abs(taken[x] - target[x]) <= 1 for x in taken)  # a target may end in a half
    tokens = packing.encoder(packing.word_tokenizer())
    whole = sum(len(x) // 4 for x in tokens.encode([r.text.encode() for r in got[4].collect()]))
    assert got[5].agg(F.sum("length")).first()[0] == whole
    parts = lambda d: sorted((r.doc_id, r.doc_tokens) for r in d.where("start = 0").collect())
    assert parts(corpus_pipeline.run(spark, str(tmp_path))) == parts(got[5])


def test_mixed_copies_add_up(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(i, text(10 + i % 7), "en", "big" if i < 30 else f"small{i % 2}", len(text(10 + i % 7)), *OTHERS) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = {}
    for r in mixing.repeat(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    sized = docs.select("source", F.size(F.split("text", " ")).cast("long").alias("size"))
    for r in mixing.targets(sized, mixing.WEIGHTS, 3).collect():
        assert taken[r.source] == round(r.target)
