"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments: each slice of documents becomes one row that
stores, for every distinct word, the sorted list of places where it stands.
Segments are shards, so building needs no shuffle, no list can outgrow a slice,
and a word that is everywhere is spread over all of them.  The index is written
to the shared folder, and searches read it.

A phrase is looked up from its rarest words: windows are kept by their rarest
word, so a segment looks only at windows whose rarest word it has; the shortest
list, moved by the word's offset in the phrase, is intersected with the next
shortest one, and so on while candidates are left.  Proximity search keeps the
places where the rarest words of an item stand close together in any order.

Items are the stated query set: they go to the tasks in blocks of at most
BLOCK_WORDS words, and every block searches the same stored index.

Defined cases: null or empty texts have no words and no hits; items with null
text or null id are no items; repeated documents and items are treated each on
its own; items with the same window all count; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gridquarry.llm import textkit as tk

INDEX = "doc_ids array<bigint>, doc_words array<int>, terms array<binary>, counts array<int>, positions binary, segment string"
MATCHES = "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, items array<bigint>, near array<bigint>"
NEAR = "doc_id bigint, item_id bigint, start int, end int"
#: Rows of the index are megabytes each: row groups end by bytes, which else are looked at after 100 rows only.
WIDE = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Items are broadcast in blocks of at most so many words.
BLOCK_WORDS = 1_000_000


def _segment(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The index row of one slice of documents."""
    codes, terms, bounds, *_ = tk.words(texts, tk.ALNUM)
    lengths = np.diff(bounds)
    place = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    by_term = np.argsort(codes, kind="stable")
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([terms], pa.list_(pa.binary())),
            pa.array([np.bincount(codes, minlength=len(terms)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([place[by_term].astype("<i4").tobytes()], pa.binary()),
            pa.array([uuid.uuid4().hex], pa.string()),
        ],
        names=["doc_ids", "doc_words", "terms", "counts", "positions", "segment"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, one row for each segment, which `segment` names.  `positions` holds the lists of all terms one after the other, as little-endian int32; `counts` has their lengths.

    A place is the number of the word in its segment plus the number of documents before it, so that no phrase runs from one document into the next.
    """

    tk.light_batches(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield _segment(part.column("doc_id").cast(pa.int64()), part.column("text"))

    return tk.stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(segments, INDEX), "index", **WIDE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the index one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
        tk.release()


class Items:
    """A block of test items: their words, and the distinct windows with the items that have them."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        found = tk.words(pa.array([t for _, t in rows], pa.string()), tk.ALNUM)
        self.terms = {w: k for k, w in enumerate(found.vocabulary)}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.words = []
        for d, (item, _) in enumerate(rows):
            own = found.codes[found.bounds[d] : found.bounds[d + 1]].tolist()
            self.words.append((item, own))
            for at in range(max(1, len(own) - window + 1)) if own else ():
                owners[tuple(own[at : at + window])].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in owners:
            by_length[len(w)].append(w)
        common = np.bincount(found.codes, minlength=len(found.vocabulary)) if len(found.codes) else np.zeros(0, np.int64)
        self.windows = []
        for n, ws in sorted(by_length.items()):
            words = np.array(ws, np.int32)
            rarest = words[np.arange(len(words)), common[words].argmin(axis=1)]
            order = np.argsort(rarest, kind="stable")
            bounds = np.searchsorted(rarest[order], np.arange(len(common) + 1))
            self.windows.append((n, words[order], [sorted(owners[ws[k]]) for k in order.tolist()], bounds))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The stated test items, never more than BLOCK_WORDS words (or one item) at a time on the driver."""
    block, size = [], 0
    for item, text in items.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        more = len(text) // 2 + 1
        if block and size + more > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += more
    yield block


class Segment:
    """The lists of one index row."""

    def __init__(self, row: dict, known: dict[bytes, int], n_known: int | None = None):
        self.ids, self.doc_words = row["doc_ids"], np.array(row["doc_words"], np.int64)
        self.first = np.append(0, np.cumsum(self.doc_words + 1))
        ends = np.cumsum(np.array(row["counts"], np.int64))
        places = np.frombuffer(row["positions"], "<i4")
        self.lists: dict[int, np.ndarray] = {}
        self.sizes = np.zeros((len(known) if n_known is None else n_known) + 1, np.int64)
        for k, term in enumerate(row["terms"]):
            if (own := known.get(term)) is not None:
                self.lists[own] = places[ends[k - 1] if k else 0 : ends[k]]
                self.sizes[own] = len(self.lists[own])

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the phrase starts: lists moved by their offset, shortest first."""
        order = np.argsort(self.sizes[terms], kind="stable")
        left = self.lists[int(terms[order[0]])] - order[0]
        for k in order[1:]:
            other = self.lists[int(terms[k])]
            at = np.searchsorted(other, left + k)
            left = left[other[np.minimum(at, len(other) - 1)] == left + k]
            if not len(left):
                break
        return left

    def near(self, chosen: list[int], slop: int) -> list[tuple[int, int]]:
        """The smallest stretch of at most `slop` words of one document that holds all chosen terms, for each place of the first of them."""
        at = self.lists[chosen[0]].astype(np.int64)
        doc = self.doc_of(at)
        best_low, best_high = at.copy(), np.full(len(at), np.iinfo(np.int64).max)
        for back in range(slop):
            low, high = at - back, at
            for t in chosen[1:]:
                after = np.append(self.lists[t], np.iinfo(np.int32).max).astype(np.int64)
                high = np.maximum(high, after[np.searchsorted(self.lists[t], low)])
            ok = (low >= self.first[doc]) & (high < self.first[doc + 1]) & (high - low < np.minimum(slop, best_high - best_low))
            best_low[ok], best_high[ok] = low[ok], high[ok]
        ok = best_high - best_low < slop
        return list(zip(best_low[ok].tolist(), best_high[ok].tolist(), strict=True))

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


def _hits(seg: Segment, known: Items) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which places of the segment windows cover, and for each document the items that have such windows."""
    covered = np.zeros(seg.first[-1] + 1, np.int32)
    found: dict[int, set[int]] = defaultdict(set)
    here = np.array(sorted(seg.lists), np.int64)
    for n, windows, owners, bounds in known.windows:
        counts = bounds[here + 1] - bounds[here]
        looked = np.repeat(bounds[here] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        for w in looked[(seg.sizes[windows[looked]] > 0).all(axis=1)].tolist():
            at = seg.phrase(windows[w])
            if len(at):
                np.add.at(covered, at, 1)
                np.add.at(covered, at + n, -1)
                for d in np.unique(seg.doc_of(at)).tolist():
                    found[d].update(owners[w])
    return np.cumsum(covered)[:-1] > 0, found


def _matches(seg: Segment, known: Items) -> pa.RecordBatch:
    hit, found = _hits(seg, known)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    doc = seg.doc_of(starts)
    n_spans = np.bincount(doc, minlength=len(seg.ids))
    own = [sorted(found.get(d, ())) for d in range(len(seg.ids))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seg.ids, pa.int64()),
            pa.array(seg.doc_words, pa.int64()),
            tk.listed((starts - seg.first[doc]).astype(np.int32), n_spans, pa.int32()),
            tk.listed((ends - seg.first[doc]).astype(np.int32), n_spans, pa.int32()),
            pa.array(own, pa.list_(pa.int64())),
        ],
        names=["doc_id", "n_words", "starts", "ends", "items"],
    )


def find_phrases(index: DataFrame, items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text", rarest: int = 4, slop: int = 25) -> DataFrame:
    """For each document: n_words, the stretches [start, end) of its words that windows of the items cover, those items, and near: the items whose `rarest` rarest words stand within `slop` words (0: none are sought)."""

    def search(block: list[tuple[int, str]]):
        wanted, _, _ = _wanted(index, block, rarest) if slop else ([], {}, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(block, window)
            for row in _rows(batches):
                seg = Segment(row, known.terms)
                found = _matches(seg, known)
                near: list[set[int]] = [set() for _ in range(found.num_rows)]
                for d, item, _, _ in _near(seg, wanted, slop) if wanted else ():
                    near[d].add(item)
                yield found.append_column("near", pa.array([sorted(x) for x in near], pa.list_(pa.int64())))

        return run

    return _over_blocks(index, search, _blocks(items, id_col, text_col))


def _over_blocks(index: DataFrame, search, blocks: Iterator[list[tuple[int, str]]]) -> DataFrame:
    """Every segment is searched for every block of items; with several blocks the stretches found for a document are merged."""
    parts = list(blocks)
    if len(parts) == 1:
        return index.mapInArrow(search(parts[0]), MATCHES)

    def pinned(block):
        inner = search(block)

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    seg = batch.column("segment")[k].as_py()
                    for out in inner([batch.slice(k, 1)]):
                        place = pa.array([f"{seg}:{i}" for i in range(out.num_rows)])
                        yield out.append_column("place", place)

        return run

    found = None
    for block in parts:
        part = tk.stored(index.mapInArrow(pinned(block), MATCHES + ", place string"), "matches")
        found = part if found is None else found.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= x["starts"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(done, F.array(x))),
    )
    out = found.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    return out.select("doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", "near")


def _frequencies(index: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """For each known term: how many documents of the whole index have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = Segment(row, known)
            own = list(seg.lists)
            n = [len(np.unique(seg.doc_of(seg.lists[t]))) for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n, pa.int64())], names=["term", "n"])

    out = np.zeros(len(known), np.int64)
    for r in index.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def _wanted(index: DataFrame, block: list[tuple[int, str]], rarest: int) -> tuple[list[tuple[int, list[int]]], dict[bytes, int], int]:
    """The rarest words of each item of a block, by the number of documents of the whole index, then by spelling; and those words' numbers.

    Words that no document has are passed over; an item with too few others has none.
    """
    known = Items(block, 1)
    spelt, n_docs = list(known.terms), _frequencies(index, known.terms)
    wanted = []
    for item, own in known.words:
        terms = set(own)
        chosen = sorted((t for t in terms if n_docs[t]), key=lambda t: (n_docs[t], spelt[t]))[:rarest]
        if chosen and len(chosen) == min(rarest, len(terms)):
            wanted.append((item, chosen))
    return wanted, {spelt[t]: t for _, chosen in wanted for t in chosen}, len(spelt)


def _near(seg: Segment, wanted: list[tuple[int, list[int]]], slop: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, start, end) of every match by proximity in a segment; items are tried by their rarest word."""
    by_word: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for item, chosen in wanted:
        by_word[chosen[0]].append((item, chosen))
    for word in sorted(set(by_word) & set(seg.lists)):
        for item, chosen in by_word[word]:
            if (seg.sizes[chosen] > 0).all():
                for low, high in seg.near(chosen, slop):
                    d = int(seg.doc_of(np.array([low]))[0])
                    yield d, item, low - int(seg.first[d]), high + 1 - int(seg.first[d])


def find_near(index: DataFrame, items: DataFrame, rarest: int = 4, slop: int = 25, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start, end): the `rarest` rarest words of the item stand within `slop` words of the document.

    Rarest in the whole index, so that results do not depend on how it is cut into segments.
    """
    out = None
    for block in _blocks(items, id_col, text_col):
        wanted, used, size = _wanted(index, block, rarest)

        def run(batches, wanted=wanted, used=used, size=size):
            for row in _rows(batches):
                seg = Segment(row, used, size)
                rows = [(seg.ids[d], item, low, high) for d, item, low, high in _near(seg, wanted, slop)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "end"])

        part = index.mapInArrow(run, NEAR)
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, near and contaminated: at least one word in `one_in` stands in a window of an item."""
    found = find_phrases(build_index(docs, id_col, text_col), items, window)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def _marked(block: list[tuple[int, str]], window: int, one_in: int, text_col: str, name: str, first: bool, last: bool):
    """The rows with a column that is carried from one block of items to the next: a bit for each word, set by this block or the ones before.

    The last block's pass gives the rows that stay, without that column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(block, window)
        for batch in batches:
            for part in tk.slices(batch, text_col):
                row = _segment(pa.array(range(part.num_rows), pa.int64()), part.column(text_col)).to_pylist()[0]
                seg = Segment(row, known.terms)
                hit, _ = _hits(seg, known)
                own = [np.packbits(hit[x:y]) for x, y in zip(seg.first[:-1].tolist(), (seg.first[1:] - 1).tolist(), strict=True)]
                if not first:
                    own = [h | np.frombuffer(b, np.uint8) for h, b in zip(own, part.column(name).to_pylist(), strict=True)]
                rows = part if first else pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])
                if last:
                    n_hit = [int(np.unpackbits(h).sum()) for h in own]
                    keep = [not (h and one_in * h >= n) for h, n in zip(n_hit, seg.doc_words.tolist(), strict=True)]
                    yield rows.filter(pa.array(keep, pa.bool_()))
                else:
                    yield rows.append_column(name, pa.array([h.tobytes() for h in own], pa.binary()))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not contaminated.

    The rows themselves are at hand here, so each slice's postings are built, searched and let
    go without being stored; with items of more than one block, one pass follows another.
    """
    out, name, blocks = docs, tk.free("_hit", docs.columns), list(_blocks(items, item_id_col, item_text_col))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        schema = docs.schema if last else StructType([*docs.schema.fields, StructField(name, BinaryType())])
        out = out.mapInArrow(_marked(block, window, one_in, text_col, name, k == 0, last), schema)
    return out
