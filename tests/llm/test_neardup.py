import random

from gridquarry.llm import neardup as nd
from gridquarry.llm.queries import op7_jaccard_join

SF = "/root/testdata/sf0.001"


def brute(docs, width=5, threshold=0.8):
    def shingles(text):
        w = [x.lower() for x in (text or "").split()] if (text or "").isascii() else fold(text).split()
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    def fold(text):
        return "".join(c.lower() if c.isascii() else c for c in text).replace(" ", "_").replace(" ", "_").replace("\x85", "_")

    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            x, y = sets[a], sets[b]
            if x == y or (x and y and 5 * len(x & y) >= 5 * threshold * len(x | y) - 1e-6):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for k in range(n):
        own = [docs[j][0] for j in range(n) if root(j) == root(k) and docs[j][0] is not None]
        low[k] = min(own, default=None)
    return sorted(((docs[k][0], low[k], links[k], sum(s == sets[k] for s in sets)) for k in range(n)), key=str)


def result(frame):
    return sorted((tuple(r) for r in nd.jaccard_join(frame).collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op7_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(docs)
    assert sum(r[2] > 0 for r in got) > 5


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (None, "a b"), (7, "x " * 9000), (8, "x " * 9001), (8, "x " * 9001), (None, "only null " * 4)]
    for d in range(20, 50):
        own = list(base)
        for _ in range(d % 3):
            own[rng.randrange(60)] = f"z{rng.randrange(9)}"
        docs.append((d, " ".join(own)))
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id bigint, text string, size int, hi string")
    assert result(frame) == brute(docs)
    assert nd.jaccard_join(frame.limit(0)).count() == 0


def test_depth_is_shortened_until_the_recall_is_met():
    assert nd.depth_for(0.8, 0.9999) == 6
    assert nd.depth_for(0.95, 0.9999) == 8
    assert nd.depth_for(0.5, 0.99) < 4


def chained(n, step=2, words=60):
    """Texts whose windows slide along one long text: only neighbours are alike, though all hang together."""
    flow = [f"w{k}" for k in range(n * step + words)]
    return [(d, " ".join(flow[d * step : d * step + words])) for d in range(n)]


def test_wide_chains_are_compared_run_by_run(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    docs = chained(120, step=1) + [(500 + d, " ".join(f"q{k}" for k in range(80)) + f" z{d}") for d in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(frame) == brute(docs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(200)] + [(names[250], names[k]) for k in range(250, 399)] + [(5, 5)]
    low_chain, low_star = min(names[:201]), min(names[250:399])
    got = dict(tuple(r) for r in nd.graph.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {n: low_chain for n in names[:201]} | {n: low_star for n in names[250:399]}


def test_prefixes_are_shortened_as_far_as_the_data_ask(spark, monkeypatch):
    ends = []
    walked = nd._walked
    monkeypatch.setattr(nd, "_walked", lambda *a, **k: ends.append(walked(*a, **k)) or ends[-1])
    close = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(120)]
    far = [(d, " ".join((f"c{d // 2}-{k}" if d % 2 or k % 48 else f"other{d}-{k}") for k in range(400))) for d in range(120)]
    for docs in (close, far):
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        assert result(frame) == brute(docs)
    assert ends[0] == nd.PATH
    assert ends[1] < ends[0]


def test_a_rare_pair_at_the_threshold_is_found_among_very_many_that_are_close(spark, monkeypatch):
    ends = []
    walked = nd._walked
    monkeypatch.setattr(nd, "_walked", lambda *a, **k: ends.append(walked(*a, **k)) or ends[-1])
    docs = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(120)]
    own = [f"s50-{k}" for k in range(190)]
    docs += [(500, " ".join(own)), (501, " ".join(f"d50-{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(own)))]  # meet at prefixes of 6 values only
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)
    assert ends == [nd.depth_for(0.8, 0.9999)]


def test_length_comes_from_all_candidate_pairs(spark, monkeypatch):
    ends = []
    walked = nd._walked
    monkeypatch.setattr(nd, "_walked", lambda *a, **k: ends.append(walked(*a, **k)) or ends[-1])
    docs = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(120)]
    own = [f"s0-{k}" for k in range(190)]
    docs += [(500, " ".join(own)), (501, " ".join(f"d0-{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(own)))]  # meet at whole paths
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)
    assert ends == [nd.depth_for(0.8, 0.9999)]


def test_pairs_parted_by_partitions_count_for_the_length(spark):
    docs = [(d, " ".join(f"c{d // 2}-{k}" for k in range(400)) + (" x y" if d % 2 else "")) for d in range(6)]
    own = [f"s50-{k}" for k in range(190)]
    docs += [(500, " ".join(own)), (501, " ".join(f"d50-{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(own)))]  # meet in 3 trees, at prefixes of 6 values
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 80)  # 256 sorted rows; the pair's second is the first of a partition each time
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    frame = session.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "0L as h", "text")
    signed = nd.tk.stored(frame.mapInArrow(nd._signatures(5), nd.SIGNED), "signed")
    edges, depth = nd.candidate_edges(signed.select("hi", "lo", "signature"), 0.8, 0.9999)
    name = {(r.hi, r.lo): r.doc_id for r in signed.collect()}
    assert depth == nd.depth_for(0.8, 0.9999)
    assert {frozenset(name[tuple(x)] for x in r) for r in edges.collect()} == {frozenset(x) for x in ((0, 1), (2, 3), (4, 5), (500, 501))}
