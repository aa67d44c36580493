"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `length` consecutive words.  Its minimiser is the smallest hash
among its runs of RUN words.  Consecutive windows with the same minimiser form
one super-k-mer: they travel as one packed string to the bucket that the
minimiser names, so all copies of a window meet in one bucket without every
window being sent on its own.  In a bucket, sorting counts the windows exactly.

Hot groups: copies of a super-k-mer collapse before the shuffle to one string
with a count.  Runs that start very many super-k-mers (a passage in a third of
all documents, each time in other surroundings) rank behind all others, so
windows around them are dealt out by their rarer runs.  The places of a
super-k-mer never travel with it; they meet the verdict in a plain equi-join
that Spark can split, and places of equal rows collapse.

Defined cases: null text counts as no words; documents shorter than a window
keep everything; a document that is there twice, id and all, is two documents,
so all its windows repeat; an empty table gives an empty result.  Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: Words of the runs that are compared to find a minimiser.
RUN = 4
#: Longest super-k-mer in windows; a longer one is sent in parts.
PART = 4096
#: Bytes of text that are packed together; more text packs better.
SLICE = 6 << 20
#: A run is hot if it starts at least HOT_LEAST super-k-mers and more than one in HOT_SHARE of all; so there are never more than HOT_SHARE hot runs.
HOT_LEAST, HOT_SHARE = 2_000, 2_000_000
#: Bytes of text to a task of four buckets, and parts in which a bucket is judged; strings are about three times their text.
BUCKET, PARTS = 128 << 20, 32
#: Strings of a part that wait in memory before they are compressed.
WAITING = 1 << 20

STRINGS = "bucket bigint, parts array<int>, sizes array<int>, counts array<int>, packed binary"
PLACES = "hi bigint, lo bigint, doc_id bigint, h bigint, start int"
VERDICTS = "hi bigint, lo bigint, starts array<int>, ends array<int>"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, have = values, 1
    while have < width:
        step = min(have, width - have)
        span = np.minimum(span[:-step], span[step:])
        have += step
    return span


def _superkmers(found: tk.Words, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    run = min(RUN, length)
    n = len(found.starts) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = tk.byte_hashes(found.letters, found.starts[:-1], found.starts[1:])
    rank = tk.run_hashes(hashes, run) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
        rank = np.where(hot[at] == rank, rank | np.uint64(1 << 63), rank)
    least = _sliding_min(rank, length - run + 1)
    ends = np.repeat(found.bounds[1:], np.diff(found.bounds))[: len(least)]
    valid = np.arange(len(least)) + length <= ends
    same = np.append(False, (least[1:] == least[:-1]) & valid[:-1])
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.append(same[1:] & valid[1:], False))
    count = last - first + 1
    if len(count) and count.max() > PART:
        parts = -(-count // PART)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * PART, np.minimum(np.repeat(count, parts) - nth * PART, PART)
    return first, count, least[first]


def _counted(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """The hot runs, counted over all documents, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                found = tk.bare_words(part.column("text"), tk.WHITE)
                _, _, least = _superkmers(found, length, np.zeros(0, np.uint64))
                values, counts = np.unique(least, return_counts=True)
                kind = np.append(np.zeros(len(values), np.int32), (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.append(values.view(np.int64), (0, 0)), pa.int64()), pa.array(np.append(counts, (len(least), len(found.letters) + len(found.starts))), pa.int64())], names=["kind", "run", "n"])

    counted = docs.select("text").mapInArrow(run, "kind int, run bigint, n bigint").groupBy("kind", "run").agg(F.sum("n").alias("n"))
    counted = tk.stored(counted.where((F.col("kind") > 0) | (F.col("n") >= HOT_LEAST)), "runs")
    total = {r["kind"]: r["n"] for r in counted.where("kind > 0").collect()}
    top = counted.where((F.col("kind") == 0) & (F.col("n") * HOT_SHARE > total.get(1, 0))).select("run").toArrow()["run"].to_numpy()
    tk.unstored(counted)
    return np.sort(top.view(np.uint64)), total.get(2, 0)


def _strings(length: int, hot: np.ndarray, buckets: int):
    """The super-k-mers of each slice, equal ones once, packed by bucket; in a pack they stand part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                found = tk.bare_words(part.column("text"), tk.WHITE)
                first, count, least = _superkmers(found, length, hot)
                text, at = tk.spaced(found)
                begin, end = at[first].tolist(), (at[first + count + length - 1] - 1).tolist()
                name = tk.mixed(least) % np.uint64(buckets * PARTS)
                by_part: dict[int, Counter[bytes]] = defaultdict(Counter)
                for b, x, y in zip(name.tolist(), begin, end, strict=True):
                    by_part[b][text[x:y]] += 1
                rows: dict[int, list[int]] = defaultdict(list)
                for b in sorted(by_part):
                    rows[b // PARTS].append(b)
                joined = {b: b"\n".join(c) for b, c in by_part.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(rows), pa.int64()),
                        pa.array([[b % PARTS for b in own] for own in rows.values()], pa.list_(pa.int32())),
                        pa.array([[len(joined[b]) for b in own] for own in rows.values()], pa.list_(pa.int32())),
                        pa.array([[n for b in own for n in by_part[b].values()] for own in rows.values()], pa.list_(pa.int32())),
                        pa.array([pack.compress(b"".join([joined[b] for b in own])) for own in rows.values()], pa.binary()),
                    ],
                    names=["bucket", "parts", "sizes", "counts", "packed"],
                )

    return run


def _name(packed: bytes) -> tuple[int, int]:
    digest = tk.digest16(packed)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _places(length: int, hot: np.ndarray):
    """Where each super-k-mer stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                found = tk.bare_words(part.column("text"), tk.WHITE)
                first, count, _ = _superkmers(found, length, hot)
                text, at = tk.spaced(found)
                names = b"".join([tk.digest16(text[x:y]) for x, y in zip(at[first].tolist(), (at[first + count + length - 1] - 1).tolist(), strict=True)])
                names = np.frombuffer(names, "<i8").reshape(-1, 2)
                doc = np.searchsorted(found.bounds, first, "right") - 1
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0]), pa.array(names[:, 1]), part.column("doc_id").take(take), part.column("h").take(take), pa.array((first - found.bounds[doc]).astype(np.int32))],
                    names=["hi", "lo", "doc_id", "h", "start"],
                )

    return run


def _repeated_windows(strings: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the strings, whether a window that occurs more than once starts there; and the strings' bounds in words."""
    text = b" ".join(strings) + b" "
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 0x20)
    at = np.append(0, ends + 1)
    bounds = np.searchsorted(at, np.append(0, np.cumsum([len(s) + 1 for s in strings])))
    windows = np.diff(bounds) - length + 1
    start = np.arange(windows.sum()) + np.repeat(bounds[:-1] - (np.cumsum(windows) - windows), windows)
    weight = np.repeat(counts, windows)
    hashes = tk.run_hashes(tk.byte_hashes(data, at[:-1], ends), length)[start]
    order = np.argsort(hashes, kind="stable")
    ordered, start = hashes[order], start[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    again = np.flatnonzero(~new)
    low, high = at[start], at[start + length]
    pairs = zip(low[again].tolist(), high[again].tolist(), low[again - 1].tolist(), high[again - 1].tolist(), strict=True)
    differ = np.array([text[a:b] != text[c:d] for a, b, c, d in pairs], bool)
    if differ.any():  # different windows with one hash: sort those by their words
        group = np.cumsum(new)
        for g in np.unique(group[again[differ]]):
            own = np.flatnonzero(group == g)
            named = [text[a:b] for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)]
            by_words = np.array(sorted(range(len(own)), key=named.__getitem__))
            order[own], start[own] = order[own][by_words], start[own][by_words]
            new[own] = [k == 0 or named[by_words[k]] != named[by_words[k - 1]] for k in range(len(own))]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=weight[order])
    marked = np.zeros(len(ends), bool)
    marked[start] = total[group] > 1
    return marked, bounds


def _verdicts(length: int):
    """One bucket after the other: the stretches of words that repeated windows cover in each super-k-mer."""

    def judge(strings: dict[bytes, int]) -> pa.RecordBatch:
        texts = list(strings)
        marked, bounds = _repeated_windows(texts, np.fromiter(strings.values(), np.int64, len(texts)), length)
        cover = np.zeros(len(marked) + 1, np.int32)
        at = np.flatnonzero(marked)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        inside = np.cumsum(cover)[:-1] > 0
        edge = np.append(inside[:1], inside[1:] & ~inside[:-1])
        edge[bounds[:-1]] = inside[bounds[:-1]]
        stop = np.append(inside[:-1] & ~inside[1:], inside[-1:])
        stop[bounds[1:] - 1] = inside[bounds[1:] - 1]
        starts, ends = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        owner = np.searchsorted(bounds, starts, "right") - 1
        which, n = np.unique(owner, return_counts=True)
        names = [_name(texts[k]) for k in which.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, _ in names], pa.int64()),
                pa.array([x for _, x in names], pa.int64()),
                tk.listed((starts - bounds[owner]).astype(np.int32), n, pa.int32()),
                tk.listed((ends - bounds[owner]).astype(np.int32), n, pa.int32()),
            ],
            names=["hi", "lo", "starts", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        bucket, parts = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                if (b := batch.column("bucket")[k].as_py()) != bucket:
                    for part in parts.values():
                        yield judge(part.strings())
                    bucket, parts = b, {}
                own, counts, at, nth = unpack.decompress(batch.column("packed")[k].as_py()), batch.column("counts")[k].values.to_numpy(), 0, 0
                for p, size in zip(batch.column("parts")[k].as_py(), batch.column("sizes")[k].as_py(), strict=True):
                    nth += parts.setdefault(p, Part()).add(own[at : at + size], counts[nth:])
                    at += size
        for part in parts.values():
            yield judge(part.strings())

    return run


class Part:
    """Strings with counts; all but the last WAITING bytes of them are kept compressed."""

    def __init__(self):
        self.done: list[tuple[bytes, np.ndarray]] = []
        self.texts: list[bytes] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes, counts: np.ndarray) -> int:
        """Takes joined strings and as many counts, and says how many."""
        n = text.count(b"\n") + 1
        self.texts.append(text)
        self.counts.append(counts[:n])
        self.size += len(text)
        if self.size > WAITING:
            self.done.append((zstandard.compress(b"\n".join(self.texts), 1), np.concatenate(self.counts)))
            self.texts, self.counts, self.size = [], [], 0
        return n

    def strings(self) -> Counter[bytes]:
        out: Counter[bytes] = Counter()
        waiting = [(b"\n".join(self.texts), np.concatenate(self.counts))] if self.texts else []
        for packed, counts in [*((zstandard.decompress(t), c) for t, c in self.done), *waiting]:
            for text, n in zip(packed.split(b"\n"), counts.tolist(), strict=True):
                out[text] += n
        return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text", SLICE):
            found = tk.bare_words(part.column("text"), tk.WHITE)
            text, at = tk.spaced(found)
            n_removed, kept, spans = [], [], part.column("spans").to_pylist()
            for d, own in enumerate(spans):
                low, high = found.bounds[d], found.bounds[d + 1]
                if not own:
                    n_removed.append(0)
                    kept.append(text[at[low] : at[high]][:-1])
                    continue
                out = np.zeros(high - low + 1, np.int32)
                edges = np.array([(x["s"], x["e"]) for x in own])
                np.add.at(out, edges[:, 0], 1)
                np.add.at(out, edges[:, 1], -1)
                stay = np.cumsum(out)[:-1] == 0
                n_removed.append(int((~stay).sum()))
                turn = np.flatnonzero(np.diff(np.concatenate(([0], stay.view(np.int8), [0])))) + low
                kept.append(b"".join([text[at[x] : at[y]] for x, y in zip(turn[::2], turn[1::2], strict=True)])[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(found.bounds)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def drop_repeated(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words outside every repeated window, joined by one space.

    buckets: four to a task, and as many tasks as the bytes of all texts ask for, at BUCKET bytes each, but no fewer than the session has shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    hot, size = _counted(docs, length)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    buckets = buckets or 4 * tasks
    strings = docs.select("text").mapInArrow(_strings(length, hot, buckets), STRINGS)
    verdicts = strings.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_verdicts(length), VERDICTS)
    places = keyed.mapInArrow(_places(length, hot), PLACES)
    moved = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((x["starts"] + F.col("start")).alias("s"), (x["ends"] + F.col("start")).alias("e")))
    spans = places.join(verdicts, ["hi", "lo"]).select("doc_id", "h", moved.alias("spans")).groupBy("doc_id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
