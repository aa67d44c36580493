import numpy as np
import pyarrow as pa
import sentencepiece
from gridquarry.llm import pieces as ps
from gridquarry.llm.queries import TOKENIZER, op10_pieces
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
VOCAB = ps.Vocabulary(TOKENIZER)


def paths(text):
    """Every segmentation of a short text, by brute force, with its weight."""
    data = b" " + text.encode()
    normal = {d: k for k, d in enumerate(VOCAB.data) if d and k not in set(VOCAB.byte_piece.tolist())}
    width = {}
    at = 0
    for c in " " + text:
        width[at] = len(c.encode())
        at += len(c.encode())

    def rest(k, bare):
        if k == len(data):
            yield (), 0.0
            return
        options = [] if bare else [normal[data[k:e]] for e in range(k + 1, min(len(data), k + 48) + 1) if data[k:e] in normal]
        if not bare and data[k : k + width[k]] not in normal:
            bare = width[k]
        if bare:
            options.append(int(VOCAB.byte_piece[data[k]]))
        for p in options:
            byte = p in VOCAB.byte_piece
            for more, w in rest(k + len(VOCAB.data[p]), max(0, bare - 1) if byte else 0):
                yield (p, *more), w + VOCAB.weight[p]

    return dict(rest(0, 0))


def test_draws_follow_the_path_probabilities():
    for text in ("then", "ab a", "é☃"):
        weights = {k: np.exp(v) for k, v in paths(text).items()}
        total, n = sum(weights.values()), 20_000
        column = pa.array([text] * n)
        got = ps.sample_pieces(column, np.arange(n, dtype=np.uint64), VOCAB).to_pylist()
        counts = {k: 0 for k in weights}
        for ids in got:
            counts[tuple(ids)] += 1
        for k, w in weights.items():
            p = w / total
            assert abs(counts[k] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), min_size=1, max_size=6), st.integers(0, 2**63))
def test_round_trip(texts, key):
    column = pa.array(texts, pa.string())
    ids = ps.sample_pieces(column, np.full(len(texts), key, np.uint64), VOCAB)
    assert ps.join_pieces(ids, VOCAB).to_pylist() == texts


def test_other_decoder_agrees():
    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = ["Hello  world\n\nx", " lead and trail  ", "naïve \U0001f600 ☃", "0123 4567"]
    for ids, text in zip(ps.sample_pieces(pa.array(texts), np.arange(4, dtype=np.uint64), VOCAB).to_pylist(), texts, strict=True):
        assert model.decode(ids) == text


def test_query_is_lossless_and_reproducible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_pieces, r.ids_hash, r.lossless) for r in op10_pieces(spark, SF).collect()}
    assert len(got) == docs.count()
    assert all(x[2] for x in got.values())
    again = ps.encode(docs.repartition(7, "source"), TOKENIZER)
    assert {r.doc_id: len(r.ids) for r in again.collect()} == {k: v[0] for k, v in got.items()}
    other = ps.encode(docs, TOKENIZER, seed=1).selectExpr("doc_id", "xxhash64(ids) h").collect()
    assert sum(r.h != got[r.doc_id][1] for r in other) > 0.9 * len(got)


def test_odd_rows(spark):
    long = "x" * 30_000 + " y" * 30_000
    rows = [(1, None), (2, ""), (3, "▁ ▁▁ \x00 \n\n  "), (None, "ab"), (None, "ab"), (4, long), (4, long)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, ids int")
    got = ps.decode(ps.encode(frame, TOKENIZER), TOKENIZER).collect()
    assert sorted(map(str, ((r.doc_id, r.decoded) for r in got))) == sorted(map(str, rows))
    same = [r.ids for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert ps.decode(ps.encode(frame.limit(0), TOKENIZER), TOKENIZER).count() == 0


def test_round_trip_in_one_pass_equals_two(spark):
    rows = [(1, None), (2, ""), (3, "▁ ▁▁ \x00 \n\n  "), (None, "ab"), (None, "ab"), (4, "naïve \U0001f600 ☃ " * 400)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame in (odd, odd.limit(0), spark.read.parquet(f"{SF}/documents.parquet")):
        one, two = ps.round_trip(frame, TOKENIZER), ps.decode(ps.encode(frame, TOKENIZER), TOKENIZER)
        assert one.schema == two.schema
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
