import numpy as np
from gridquarry.llm import toxicity as tx
from gridquarry.llm.queries import op1_toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.7
    assert clean.predicted.mean() < 0.01
    assert got.score.between(0, 1).all()


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, 6), np.int32)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.6)):
        votes[:, j] = np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    votes[:, 4] = votes[:, 5] = votes[:, 3]
    posterior, accuracy, weight = tx.fit_label_model(votes, 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert accuracy[0] > accuracy[2] > accuracy[3]
    assert weight[3] < 0.5 < weight[0]


def test_odd_rows(spark):
    rows = [(k, "you vile zorg, said they " * (k % 3 + 1) if k % 4 == 0 else f"a calm day number {k} in town {k}", k % 4 == 0) for k in range(400)]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, _ in rows] + [(900, None, 0.0, "x"), (901, "", 0.0, "x"), (None, "zorg", 0.0, "x"), (902, "zorg " * 50_000, 0.0, "x"), (902, "zorg " * 50_000, 0.0, "x")], "doc_id bigint, text string, score double, voters string")
    labels = spark.createDataFrame([(i, int(y), None) for i, _, y in rows] + [(None, 1, None), (900, None, None), (5, 0, None)], "doc_id bigint, toxic int, text string")
    got = {(r.doc_id, k): r.score for k, r in enumerate(tx.toxicity(docs, labels).collect())}
    assert len(got) == 405
    by_id = {i: s for (i, _), s in got.items()}
    assert by_id[900] == by_id[901]
    assert by_id[900] < 0.5
    assert tx.toxicity(docs.limit(0), labels).count() == 0
    assert tx.toxicity(docs, labels.where(F.lit(False))).count() == 405
    assert tx.score(docs, tx.fit(docs, labels.where("toxic = 0"))).count() == 405


def plain_score(text, model):
    """The score by loops over words, from the model's tables alone."""
    import re

    import xxhash

    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]
    pieces = {w for w in words} | {w[:k] + b"*" for w in words for k in tx.PREFIXES if len(w) > k}
    features = {xxhash.xxh3_64_intdigest(p) for p in pieces}
    votes = []
    for lexicon in model.lexicons.values():
        n = len(features & set(lexicon.tolist()))
        votes += [n > 0, n >= 2, n > 0 and 100 * n >= len(words)]
    for pattern, needed in tx.PATTERNS.values():
        near = features & {xxhash.xxh3_64_intdigest(w.encode()) for w in needed}
        votes.append(bool(near) and bool(re.search(pattern, (text or "").lower())))
    margin = model.bias + sum(c for v, c in zip(votes, model.voter_coef, strict=False) if v)
    margin += sum(c for w, c in zip(model.words.tolist(), model.coef, strict=True) if w in features)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def test_scores_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = tx.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    assert all(abs(got[d] - plain_score(t, model)) < 1e-9 for d, t in texts.items())


def test_mined_voters_are_a_part_of_the_voters_only(spark):
    """Without any mined lexicon the built-in ones still tell toxic rows from others; mining adds recall."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    shares = {}
    for name, told in (("mined", labels), ("built in", labels.limit(0))):
        got = {r.doc_id: r.score >= 0.7 for r in tx.toxicity(docs, told).collect() if r.doc_id in known}
        shares[name] = [np.mean([got[d] for d, y in known.items() if d in got and y == k]) for k in (0, 1)]
    assert shares["mined"][1] >= shares["built in"][1]
    assert max(shares["mined"][0], shares["built in"][0]) < 0.01
