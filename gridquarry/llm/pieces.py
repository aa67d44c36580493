"""Sampled subword segmentation and lossless decoding over a SentencePiece vocabulary.

All segmentations of a text form a lattice of pieces.  Forward filtering sums
the probability of all paths into every node; backward sampling then draws one
path from the end, each with its exact probability.  The random numbers depend
on nothing but the row key, the number of the chunk in the text and the step,
so a row gets the same segmentation whatever the partitioning, and again after
a lost executor.

Where two characters stand side by side in no piece of the vocabulary, as at
the start of a word, the lattice falls apart without loss.  Equal chunks of a
slice share one filtered lattice, and all their draws are made together with
numpy.

The vocabulary file may hold merge ranks instead of probabilities; a piece's
weight is then (rank + RANK_OFFSET) ** -sharpness.

Defined cases: null text has null pieces, empty text none; a character without
a piece becomes its UTF-8 bytes' pieces, as does the space mark itself, so
decoding always gives the text back; rows with equal keys and texts get equal
pieces, a null key counts as a key of its own; texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridquarry.llm import textkit as tk

SPACE, MARK = 0x20, "▁".encode()
RANK_OFFSET = 10.0
SLICE_BYTES = 1 << 20
#: Probabilities are whole numbers of this many bits, so that a draw depends on nothing else in the slice.
DRAW_BITS = 40


class Pieces:
    """The pieces of a vocabulary file as bytes with plain spaces; all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.data: list[bytes] = []
        self.byte_piece = np.full(256, -1, np.int32)
        self.normal: list[int] = []
        for k in range(model.get_piece_size()):
            text = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_piece[int(text[1:-1], 16)] = k
                self.data.append(bytes([int(text[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.data.append(b"")
            else:
                self.data.append(text.encode().replace(MARK, b" "))
                self.normal.append(k)
        if (self.byte_piece < 0).any():
            raise ValueError("the vocabulary needs a piece for every byte")
        self.lengths = np.array([len(x) for x in self.data], np.int32)
        self.begins = np.append(0, np.cumsum(self.lengths))
        self.letters = np.frombuffer(b"".join(self.data), np.uint8)


class Vocabulary(Pieces):
    """Adds a trie over the pieces: step[node, byte] is the next node, piece[node] the piece that ends there or -1.

    joined[a, b]: some piece has byte a right before byte b.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        super().__init__(path)
        size, normal = len(self.data), self.normal
        self.joined = np.zeros((256, 256), bool)
        for k in normal:
            own = np.frombuffer(self.data[k], np.uint8)
            self.joined[own[:-1], own[1:]] = True
        self.weight = np.full(size, -sharpness * np.log(size + RANK_OFFSET) - 5.0)
        self.weight[normal] = -sharpness * np.log(np.arange(len(normal)) + RANK_OFFSET)
        nodes, ends, edges = {b"": 0}, {}, []
        for k in normal:
            own = self.data[k]
            for n in range(1, len(own) + 1):
                if own[:n] not in nodes:
                    nodes[own[:n]] = len(nodes)
                    edges.append((nodes[own[: n - 1]], own[n - 1], nodes[own[:n]]))
            ends[nodes[own]] = k
        self.step = np.zeros((len(nodes), 256), np.int32)
        edges = np.array(edges)
        self.step[edges[:, 0], edges[:, 1]] = edges[:, 2]
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())


class Lattices:
    """The filtered lattices of many chunks laid end to end.

    Node p + k stands behind byte p of chunk k (chunk k's first node is before its first byte).
    Edges are sorted by the node they lead to; below[e] is the probability that a draw at that
    node picks edge e or one before it.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, vocab: Vocabulary):
        n_chunks = len(starts) - 1
        sizes = np.diff(starts)
        chunk = np.repeat(np.arange(n_chunks, dtype=np.int32), sizes)
        stop = starts[1:].astype(np.int32)[chunk]
        lead = (data & 0xC0) != 0x80
        lead[starts[:-1]] = True
        at = np.flatnonzero(lead).astype(np.int32)
        width = np.diff(np.append(at, np.int32(len(data))))
        froms, tos, pieces = [], [], []
        plain = np.zeros(len(data), bool)
        place, node, last, length = at, np.zeros(len(at), np.int32), at + width, 0
        while len(place):
            node = vocab.step[node, data[place + length]]
            length += 1
            ok = np.flatnonzero(node)
            place, node, last = place[ok], node[ok], last[ok]
            own = vocab.piece[node]
            hit = np.flatnonzero(own >= 0)
            froms.append(place[hit])
            tos.append(place[hit] + np.int32(length))
            pieces.append(own[hit])
            plain[froms[-1][tos[-1] == last[hit]]] = True
            more = np.flatnonzero(place + length < stop[place])
            place, node, last = place[more], node[more], last[more]
        bare = np.flatnonzero(np.repeat(~plain[at], width)).astype(np.int32)
        froms.append(bare)
        tos.append(bare + np.int32(1))
        pieces.append(vocab.byte_piece[data[bare]])
        target = np.concatenate(tos)
        target += chunk[target - 1]
        order = np.argsort(target, kind="stable").astype(np.int32)
        target = target[order]
        self.piece = np.concatenate(pieces)[order]
        del tos, pieces
        source = np.concatenate(froms)
        del froms
        source += chunk[source]
        self.source = source[order]
        del source, order
        n_nodes = len(data) + n_chunks
        self.first = np.searchsorted(target, np.arange(n_nodes + 1))
        self.roots = starts[:-1] + np.arange(n_chunks)
        self.ends = starts[1:] + np.arange(n_chunks)
        self.below = self._filter(target, vocab.weight.astype(np.float32)[self.piece], n_nodes, chunk, starts)

    def _filter(self, target: np.ndarray, weight: np.ndarray, n_nodes: int, chunk: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum over paths, for all chunks together, one byte further at a time."""
        alpha = np.full(n_nodes, -np.inf)
        alpha[self.roots] = 0
        inner = np.arange(len(chunk), dtype=np.int32)
        depth = np.zeros(n_nodes, np.int32)
        depth[inner + chunk + 1] = inner - starts[chunk].astype(np.int32) + 1
        deepest = int(depth.max(initial=0))
        reached = depth[target].astype(np.uint16 if deepest < 65536 else np.int32)
        score = np.empty(len(target))
        by_depth = np.argsort(reached, kind="stable").astype(np.int32)
        cuts = np.append(0, np.cumsum(np.bincount(reached, minlength=deepest + 1)))[1:]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            own = by_depth[low:high]
            if not len(own):
                continue
            into = target[own]
            value = alpha[self.source[own]] + weight[own]
            score[own] = value
            head = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            most = np.maximum.reduceat(value, head)
            count = np.diff(np.append(head, len(own)))
            safe = np.where(np.isfinite(most), most, 0)
            with np.errstate(divide="ignore"):
                alpha[into[head]] = safe + np.log(np.add.reduceat(np.exp(value - np.repeat(safe, count)), head))
        del by_depth, reached, depth
        with np.errstate(invalid="ignore"):
            score -= alpha[target]
            np.exp(score, out=score)
        np.nan_to_num(score, copy=False)
        score *= 2.0**DRAW_BITS
        below = np.cumsum(np.rint(score, out=score).astype(np.int64))
        del score
        first, after = self.first[:-1], self.first[1:]
        used = np.flatnonzero((first > 0) & (after > first))
        before = np.zeros(n_nodes, np.int64)
        before[used] = below[first[used] - 1]
        below -= before[target]
        below[after[after > first] - 1] = 1 << 62
        return below

    def draw(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path for each entry of which (numbers of chunks): all their pieces in order, and how many each has."""
        node, active, steps = self.ends[which], np.arange(len(which)), []
        root = self.roots[which]
        counts = np.zeros(len(which), np.int64)
        number = 0
        while len(active):
            u = (tk.mixed(seeds[active] + np.uint64((number * 0xD1342543DE82EF95) & (2**64 - 1))) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
            edge = self.first[node[active]]
            left = np.arange(len(active))
            while len(left):
                left = left[self.below[edge[left]] <= u[left]]
                edge[left] += 1
            steps.append((active, self.piece[edge]))
            counts[active] += 1
            node[active] = self.source[edge]
            active = active[node[active] != root[active]]
            number += 1
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for k, (own, piece) in enumerate(steps):
            out[ends[own] - 1 - k] = piece
        return out, counts


def _chunks(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each non-empty text with a space before it; where chunks begin; how many each text has."""
    raw, offsets = tk.flat(column)
    sizes = np.diff(offsets)
    put = offsets[:-1][sizes > 0]
    data = np.insert(raw, put, SPACE)
    bounds = offsets + np.append(0, np.cumsum(sizes > 0))
    begins = np.ones(len(data), bool)
    begins[1:] = ~vocab.joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    begins[bounds[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begins)
    return data, np.append(starts, len(data)), np.diff(np.searchsorted(starts, bounds))


def sample_pieces(column: pa.Array, keys: np.ndarray, vocab: Vocabulary, seed: int = 0) -> pa.Array:
    """A list of piece numbers for each text."""
    data, starts, n_chunks = _chunks(column, vocab)
    counts, ids = np.zeros(len(column), np.int64), np.zeros(0, np.int32)
    if len(data):
        chunks = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        letters, at = tk.flat(chunks.dictionary)
        lattices = Lattices(letters, at, vocab)
        doc = np.repeat(np.arange(len(column)), n_chunks)
        nth = np.arange(len(codes)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        with np.errstate(over="ignore"):
            seeds = tk.mixed(tk.mixed(keys + np.uint64(seed))[doc] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, sizes = lattices.draw(codes, seeds)
        counts = np.bincount(doc, sizes, len(column)).astype(np.int64)
    lists = tk.listed(ids, counts, pa.int32())
    return pc.if_else(column.is_null(), pa.nulls(len(column), lists.type), lists) if column.null_count else lists


def join_pieces(column: pa.Array, vocab: Pieces) -> pa.Array:
    """The texts that lists of piece numbers stand for."""
    whole = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    ids = whole.flatten().to_numpy(zero_copy_only=False)
    per_row = np.diff(whole.offsets.to_numpy() - whole.offsets[0].as_py()) if len(whole) else np.zeros(0, np.int64)
    sizes = vocab.lengths[ids] if len(ids) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    data = vocab.letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(vocab.begins[ids] - (ends - sizes), sizes)] if len(ids) else np.zeros(0, np.uint8)
    row_ends = np.append(0, ends)[np.cumsum(per_row)] if len(per_row) else np.zeros(0, np.int64)
    text, low, out = data.tobytes(), 0, []
    for high, valid in zip(row_ends.tolist(), column.is_valid().to_pylist(), strict=True):
        out.append(text[low + 1 : high].decode("utf-8", "replace") if valid else None)
        low = high
    return pa.array(out, pa.string())


ENCODED = "doc_id bigint, text string, ids array<int>"


def _encoded(docs: DataFrame, model_path: str, seed: int, sharpness: float, key_col: str, text_col: str, decoded: bool) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("null key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model_path, sharpness)  # for this task only: a worker that lives on should not hold the trie
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE_BYTES):
                ids = sample_pieces(part.column("text"), part.column("key").to_numpy().view(np.uint64), vocab, seed)
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], names=["doc_id", "text", "ids"])
                yield out.append_column("decoded", join_pieces(ids, vocab)) if decoded else out
        del vocab
        tk.release()

    chosen = docs.select(F.col(key_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    return chosen.mapInArrow(run, ENCODED + ", decoded string" if decoded else ENCODED)


def encode(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids: a segmentation of the text drawn by the row's key."""
    return _encoded(docs, model_path, seed, sharpness, key_col, text_col, decoded=False)


def round_trip(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As decode after encode, in one pass: one Python worker and one vocabulary to a task instead of two."""
    return _encoded(docs, model_path, seed, sharpness, key_col, text_col, decoded=True)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of encoded, and the text that the pieces stand for."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Pieces(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield part.append_column(out_col, join_pieces(part.column(at), vocab))
            tk.release()

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_col, StringType())]))
