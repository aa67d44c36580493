"""Shared helpers: cutting Arrow string columns into words with numpy.

A slice of documents is one flat byte buffer, so words of thousands of
documents are found with a handful of vector operations instead of a Python
loop over words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridquarry.shared import stored as stored
from gridquarry.shared import unstored as unstored


SLICE_BYTES = 3 << 20


def _table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return keep, folded


#: Words are runs of anything but ASCII white space; nothing is folded.
WHITE = _table(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
#: A-Z become a-z; words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Words(NamedTuple):
    """codes[i] is the place of word i in vocabulary; document d has words[bounds[d]:bounds[d + 1]].

    letters holds the words without anything between them, word i at starts[i]:starts[i + 1].
    """

    codes: np.ndarray
    vocabulary: list[bytes]
    bounds: np.ndarray
    letters: np.ndarray
    starts: np.ndarray


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about `limit` bytes of text; a longer text is a part of its own, whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    release()


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back, since Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bare_words(column: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """As words, without codes and vocabulary."""
    keep, folded = kind
    raw, offsets = flat(column)
    nothing = np.zeros(0, np.int32)
    if not len(raw):
        return Words(nothing, [], np.zeros(len(offsets), np.int64), raw, np.zeros(1, np.int32))
    inside = ~((raw == 0x20) | (raw - np.uint8(9) <= 4)) if kind is WHITE else keep[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] |= inside[edges]
    bounds = np.searchsorted(np.flatnonzero(begins), offsets)
    kept = raw[inside] if kind is WHITE else folded[raw[inside]]
    starts = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    return Words(nothing, [], bounds, kept, starts)


def words(column: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    bare = bare_words(column, kind)
    if not len(bare.letters):
        return bare
    encoded = pa.Array.from_buffers(pa.binary(), len(bare.starts) - 1, [None, pa.py_buffer(bare.starts), pa.py_buffer(bare.letters)]).dictionary_encode()
    return bare._replace(codes=encoded.indices.to_numpy(zero_copy_only=False), vocabulary=encoded.dictionary.to_pylist())


#: An odd factor and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(size, f, np.uint64))) for f in (_FACTOR, _INVERSE))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, from running sums over all of them; equal stretches hash alike wherever they stand."""
    up, down = _powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
        sums = np.append(np.uint64(0), sums)
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spaced(found: Words) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins (one more entry for the end)."""
    n = len(found.starts) - 1
    out = np.full(len(found.letters) + n, 0x20, np.uint8)
    out[np.arange(len(found.letters)) + np.repeat(np.arange(n), np.diff(found.starts))] = found.letters
    return out.tobytes(), found.starts + np.arange(n + 1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocabulary), np.uint64, len(vocabulary))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of `length` consecutive words, by the place where it starts."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out)


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(rows.values(), schema, strict=True)], schema=schema)


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: `counts` says how many of `values` each row has."""
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def free(name: str, taken: Iterable[str]) -> str:
    """The name, or one like it that no column has."""
    while name in taken:
        name += "_"
    return name


def modest_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Lower the session's Arrow batches to `rows` rows: whole texts in batches of Spark's default size fill small executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def light_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to `size` bytes: a count of rows does not bound rows that are megabytes each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(name, str(size))
