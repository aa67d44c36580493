"""Secret scanning: fixed patterns, and character Markov models compared by log-likelihood ratio.

One Markov chain of order two is trained on random strings and one on ordinary
identifiers.  A token whose characters are far likelier under the first is a
secret that no pattern names.  Both are trained from labelled samples; without
samples of the caller's own, samples made by a fixed rule are used.

Places are code points, end exclusive.  Defined cases: null text has no spans;
texts are scanned whole; repeated rows get equal spans; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: The pattern kinds, in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 24 or more is the same as a run that is found and then long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the Markov models; numbers alone, such as those of phones and cards, are none.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Candidates have a digit, or more than one change from small to capital letters: words in one case are prose, however long.
MIXED = re.compile(r"[0-9]|[a-z][A-Z].*[a-z][A-Z]")

SPANS = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_CODE = {c: k for k, c in enumerate(ALPHABET)}

#: Parts of ordinary identifiers for the samples made by rule.
PARTS = (
    "user name file path index count value config service client server request response handler manager session cache "
    "buffer string number table column query result error message event data model view controller factory builder test "
    "time date start stop begin end open close read write get set add remove update delete create find list map node tree "
    "the and tion ing ent ation ment ness able ible ough with from that this have been were their which would about other "
    "der die und ein nicht sich auf für mit von heit keit lich schaft ung les des une dans pour avec sur tion ement eau "
    "que los las una con para por ción mente idad ado ario"
).split()


def sample_strings(n: int = 4000, seed: int = 11) -> list[tuple[str, bool]]:
    """Labelled samples by rule: random strings over usual alphabets (True), and identifiers put together from ordinary parts (False)."""
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62])
    out = []
    for k in range(n):
        letters = alphabets[k % len(alphabets)]
        out.append(("".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(16, 48)))), True))
        parts = [PARTS[i] for i in rng.integers(0, len(PARTS), int(rng.integers(3, 8)))]
        style = k % 8
        if style == 0:
            text = "".join(parts)
        elif style == 1:
            text = "_".join(parts)
        elif style == 2:
            text = "-".join(parts)
        elif style == 3:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 4:
            text = "".join(parts).upper()
        elif style == 5:
            text = "_".join(parts).upper()
        elif style == 6:
            text = "".join(p.capitalize() for p in parts) + str(int(rng.integers(0, 2030)))
        else:
            text = "/".join(parts).upper() if k % 2 else "/".join(parts)
        out.append((text, False))
    return out


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b, c]: log of how much likelier c after ab is in a random string than in an identifier."""

    ratio: np.ndarray
    cut: float

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio by character."""
        codes = np.array([_CODE.get(c, len(ALPHABET)) for c in "==" + token])
        return float(self.ratio[codes[:-2], codes[1:-1], codes[2:]].mean()) if token else 0.0


def train(samples: Iterable[tuple[str, bool]], false_alarms: float = 0.0005) -> MarkovPair:
    """Chains of order two, smoothed by their order-one and order-zero counts; the cut lets through that share of the identifiers at most."""
    size = len(ALPHABET) + 1
    counts = np.zeros((2, size, size, size))
    samples = list(samples)
    for text, secret in samples:
        codes = np.array([_CODE.get(c, len(ALPHABET)) for c in "==" + text])
        np.add.at(counts[int(secret)], (codes[:-2], codes[1:-1], codes[2:]), 1)
    logs = []
    for own in counts:
        zero = (own.sum(axis=(0, 1)) + 0.5) / (own.sum() + 0.5 * size)
        one = (own.sum(axis=0) + 5 * zero) / (own.sum(axis=(0, 2))[:, None] + 5)
        logs.append(np.log((own + 5 * one) / (own.sum(axis=2, keepdims=True) + 5)))
    pair = MarkovPair((logs[1] - logs[0]).astype(np.float32), 0.0)
    ordinary = np.array([pair.score(t) for t, secret in samples if not secret] or [0.0])
    return MarkovPair(pair.ratio, max(0.35, float(np.quantile(ordinary, 1 - false_alarms))))


def find(text: str, models: MarkovPair) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), sorted.  A token that overlaps a pattern's span is left to the pattern."""
    spans = []
    lowered = text.lower() if "=" in text or ":" in text else ""
    if any(w in lowered for w in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(spans)
    for m in TOKEN.finditer(text):
        if MIXED.search(m[0]) and all(m.end() <= s or e <= m.start() for s, _, e in base) and models.score(m[0]) > models.cut:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def scan(docs: DataFrame, models: MarkovPair | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end) of every document."""
    models = models or train(sample_strings())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t or "", models)] for t in part.column("text").to_pylist()]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, models: MarkovPair | None = None, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; every span of the text becomes `mark`, overlapping spans one, and `length_col`, if there, the new length."""
    models = models or train(sample_strings())
    at, fields = docs.columns.index(text_col), docs.schema
    n = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                texts = part.column(at).to_pylist()
                for k, text in enumerate(texts):
                    spans = find(text, models) if text else []
                    for s, e in _merged(spans)[::-1]:
                        text = text[:s] + mark + text[e:]
                    texts[k] = text
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if n is not None:
                    old = columns[n].to_pylist()
                    columns[n] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], columns[n].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, fields)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
