import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from gridquarry.llm import decontaminate as dc
from gridquarry.llm.queries import op6_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[x]
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = op6_decontaminate(spark, SF).collect()
    got = sorted((tuple(r)[:6] for r in rows), key=str)
    assert got == brute(docs, items)
    assert sum(r[5] for r in got) > 0
    near = {(d, i) for d, i, _, _ in near_brute(docs, items, 4, 25)}
    assert {r.doc_id: r.n_near for r in rows} == {d: sum(x == d for x, _ in near) for d, _ in docs}
    assert near


def odd(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    docs = [(1, None), (2, ""), (3, "A-b c! Über x9"), (4, long), (4, long), (None, "a b c"), (5, "a"), (6, "b c")]
    items = [(1, "a b C"), (2, None), (3, ""), (4, "w7 " + long[:400]), (4, "a b C"), (7, long), (8, "über")]
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id bigint, text string, n_words int, terms string")
    return docs, items, frame, spark.createDataFrame(items, "item_id bigint, text string")


def test_odd_rows(spark):
    docs, items, frame, bench = odd(spark)
    found = dc.contamination(frame, bench).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found), key=str)
    assert got == sorted((x[:4] for x in brute(docs, [i for i in items if i[1]])), key=str)
    assert dc.contamination(frame.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in dc.contamination(frame, bench.limit(0)).collect())


def test_blocks_of_items_merge(spark, monkeypatch):
    _, _, frame, bench = odd(spark)
    cols = ["doc_id", "n_words", "starts", "ends", "items"]
    index = dc.build_index(frame)
    whole = sorted(map(str, dc.find_phrases(index, bench).select(cols).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 2)
    assert sorted(map(str, dc.find_phrases(index, bench).select(cols).collect())) == whole


def test_near(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y z gamma"), (2, "gamma " + "x " * 40 + "alpha beta"), (3, "alpha beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "beta gamma alpha")], "item_id bigint, text string")
    assert [tuple(r) for r in dc.find_near(dc.build_index(docs), items, rarest=3, slop=6).collect()] == [(1, 9, 0, 6)]


def near_brute(docs, items, rarest, slop):
    texts = {d: split(t) for d, t in docs}
    out = []
    for item, text in items:
        terms = set(split(text))
        n = {t: sum(t in w for w in texts.values()) for t in terms}
        chosen = sorted((t for t in terms if n[t]), key=lambda t: (n[t], t.encode()))[:rarest]
        if not chosen or len(chosen) < min(rarest, len(terms)):
            continue
        for d, w in texts.items():
            for p in (k for k, x in enumerate(w) if x == chosen[0]):
                fits = [(b - a, -a, a, b) for a in range(max(0, p - slop + 1), p + 1) for b in range(p + 1, min(len(w), a + slop) + 1) if set(chosen) <= set(w[a:b])]
                if fits:
                    out.append((d, item, *min(fits)[2:]))
    return sorted(out)


def test_near_does_not_depend_on_segments(spark):
    draw = random.Random(5)
    docs = [(d, " ".join(draw.choices([f"t{k}" for k in range(14)], k=draw.randrange(1, 40)))) for d in range(60)]
    docs += [(100, "red green blue"), (101, "other words gamma"), (102, "alpha beta x x gamma red"), (103, "reworded")]
    items = [(1, "alpha beta gamma red absent"), (2, "t1 t2 t3 t4 t5 alpha"), (3, "t6 t7 t8 t9 t10"), (4, "absent missing"), (5, "t1 reworded")]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")
    want = near_brute(docs, items, 4, 12)
    assert (102, 1, 0, 6) in want
    assert {x[1] for x in want} >= {1, 3}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows in ("1", "7", "10000"):
            spark.conf.set(key, rows)
            assert sorted(tuple(r) for r in dc.find_near(dc.build_index(frame), bench, 4, 12).collect()) == want
    finally:
        spark.conf.set(key, before)


def test_filter_drops_the_same_rows_with_one_block_and_with_many(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    flags = {r[0]: r[5] for r in brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])}
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, None)], docs.schema)
    for words in (1_000_000, 400):
        monkeypatch.setattr(dc, "BLOCK_WORDS", words)
        got = dc.drop_contaminated(docs.unionByName(odd), items)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted([-1, -2, *(d for d, bad in flags.items() if not bad)])
    assert any(flags.values())


def test_pipeline_stages_take_one_python_worker_to_a_task(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (cp.drop_contaminated, cp.redact_secrets, cp.encode_pieces):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_searches_get_few_segments_at_once(spark):
    # 16 texts of more than a slice each in one task: the index is not handed over as one batch
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(500_000)), lambda k: (k % 5_000).cast("string")))
    docs = spark.range(16).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" " * 1_000_000)).alias("text"))
    index = dc.build_index(docs)
    sizes = index.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n bigint").collect()
    assert sum(r["n"] for r in sizes) == 16 and max(r["n"] for r in sizes) <= 6
