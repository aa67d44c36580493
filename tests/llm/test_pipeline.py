import corpus_pipeline as cp
import pytest
from gridquarry.llm import secrets, toxicity
from gridquarry.llm import textkit as tk
from test_decontaminate import brute as contaminated
from test_neardup import brute as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = tk.stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_each_stage_equals_a_plain_version(spark, stages):
    before, mild, single, clean, safe, last = (rows(x) for x in stages)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(stages[0], labels).collect()}
    assert set(mild) == {d for d in before if scores[d] < 0.7}
    groups = near([(d, r.text) for d, r in mild.items()])
    assert set(single) == {low for _, low, _, _ in groups}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(d, r.text) for d, r in single.items()], items) if r[5]}
    assert bad
    assert set(clean) == set(single) - bad
    models = secrets.train(secrets.sample_strings())
    for d, r in safe.items():
        text = clean[d].text
        for s, e in secrets._merged(secrets.find(text, models))[::-1]:
            text = text[:s] + "[SECRET]" + text[e:]
        assert (r.text, r.n_chars) == (text, len(text) if text != clean[d].text else r.n_chars)
    assert set(safe) == set(clean)
    assert set(last) == set(safe)
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in last.values())


def test_run_equals_the_stages(spark, stages):
    got = {r.doc_id: r.ids for r in cp.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids for r in stages[-1].collect()}


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "a b c", "en", "s", 5), (3, long, "en", "s", None), (4, long, "en", "s", 1), (5, 'token = "abcdef123456"', "en", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        own = frame
        for _, stage in cp.STAGES:
            own = tk.stored(stage(spark, own, SF), "odd")
        got = {r.doc_id: r for r in own.select("doc_id", "lossless").collect()}
        assert set(got) <= {1, 2, None, 3, 5}
        assert all(r.lossless for r in got.values())


def test_other_columns_stay_whatever_their_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_k", "_h", "_hit", "_score", "toxic_score", "hi", "first", "_row", "size"]
    wide = docs.selectExpr("*", *(f"doc_id + {k} as `{n}`" for k, n in enumerate(names)))
    plain = docs
    for name, stage in cp.STAGES[:-1]:
        wide, plain = tk.stored(stage(spark, wide, SF), name), tk.stored(stage(spark, plain, SF), name)
        assert wide.columns == [*docs.columns, *names]
        assert {r.doc_id for r in wide.collect()} == {r.doc_id for r in plain.collect()}
        assert all(r[n] == r.doc_id + k for r in wide.collect() for k, n in enumerate(names))


def test_near_duplicates_at_the_threshold_go_among_very_many_that_are_close(spark):
    docs = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(120)]
    own = [f"s50-{k}" for k in range(190)]
    docs += [(500, " ".join(own)), (501, " ".join(f"d50-{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(own)))]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, frame, SF).collect()}
    assert kept == {*range(0, 120, 2), 500}


def test_near_duplicates_go_where_partitions_part_them_in_all_trees(spark):
    docs = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(2)]
    own = [f"s1527-{k}" for k in range(190)]
    docs += [(500, " ".join(own)), (501, " ".join(f"d1527-{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(own)))]  # meet in 4 trees, at prefixes of 6 or 7 values
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 49)  # 128 sorted rows; the pair's second is the first of a partition each time
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    frame = session.createDataFrame(frame.rdd, frame.schema)
    assert {r.doc_id for r in cp.drop_near_duplicates(session, frame, SF).collect()} == {0, 500}
