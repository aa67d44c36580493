"""Toxicity by weak supervision.

Many voters look at a text: built-in lexicons, patterns, and lexicons mined from
the labelled rows.  Each votes for toxic or abstains, and
one votes against where no other has found anything.  A generative label
model estimates every voter's accuracy and coverage by expectation maximisation
without trusting any single one; voters whose votes stay correlated after the
label is accounted for share their weight.  The posterior labels that come out
train a linear classifier over words and voters, and that classifier scores.

Fitting uses a bounded sample of the labelled rows (`max_rows`, the rows with
the smallest hash of their id); scoring reads every text whole.

Defined cases: null text is scored like empty text; words are those of the
whole text; a text without any known word gets the score of the bias; without
labelled rows the model falls back on the built-in lexicons; repeated rows get
equal scores; of different labels of one id the larger counts.  Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridquarry.llm import textkit as tk

#: Insults by language, as plain word lists.
LEXICONS = {
    "insults_en": "idiot idiots moron morons imbecile loser losers scum trash clown stupid dumb dumbass fool pathetic worthless disgusting".split(),
    "abuse_en": "bastard bitch asshole bullshit crap fuck fucking fucker shit cunt dick slut whore jerk".split(),
    "insults_de": "idiot dummkopf trottel abschaum versager widerlich erbärmlich wertlos dumm arschloch scheiße scheisse".split(),
    "insults_fr": "idiot imbécile crétin ordure minable nul stupide dégoûtant pathétique connard salaud merde".split(),
    "insults_es": "idiota imbécil estúpido escoria basura patético inútil asqueroso payaso cabrón mierda gilipollas".split(),
}
#: Patterns over the lower-cased text, each with words of which one has to be there.
PATTERNS = {
    "you_are": (r"\byou(?:'re| are)? (?:an? |such |so )*(?:idiot|moron|loser|scum|trash|clown|stupid|pathetic|worthless|disgusting)", ("you",)),
    "threat": (r"\b(?:kill|hurt|punch|destroy) (?:you|yourself|him|her|them)\b", ("kill", "hurt", "punch", "destroy")),
    "hate": (r"\b(?:i|we) (?:hate|despise) (?:you|them|him|her)\b", ("hate", "despise")),
    "go_away": (r"\b(?:shut up|get lost|go to hell|drop dead)\b", ("shut", "lost", "hell", "drop")),
}
#: Beginnings of words, in bytes, that count as features too.
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Lexicons and words are sorted arrays of feature hashes."""

    voters: list[str]
    accuracy: np.ndarray
    weight: np.ndarray
    lexicons: dict[str, np.ndarray]
    words: np.ndarray
    coef: np.ndarray
    voter_coef: np.ndarray
    bias: float


def _hashed(words: Iterable[str]) -> np.ndarray:
    return np.sort(tk.word_hashes([w.lower().encode() for w in words]))


def _inside(values: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Which of the values the sorted lexicon has."""
    if not len(lexicon):
        return np.zeros(len(values), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)] == values


def _voter_names(lexicons: dict[str, np.ndarray]) -> list[str]:
    return [f"{name}:{kind}" for name in lexicons for kind in ("any", "two", "dense")] + list(PATTERNS) + ["nothing_found"]


class Features:
    """A slice's documents as pairs (document, feature): distinct words and, apart from those, beginnings of words."""

    def __init__(self, column: pa.Array):
        found = tk.words(column, tk.ALNUM)
        self.n = len(column)
        self.sizes = np.diff(found.bounds)
        raw, self.offsets = tk.flat(column)
        self.data = raw.tobytes()
        size = max(1, len(found.vocabulary))
        doc, code = np.divmod(np.unique(np.repeat(np.arange(self.n), self.sizes) * size + found.codes), size)
        hashes = [tk.word_hashes(found.vocabulary)]
        for k in PREFIXES:
            hashes.append(tk.word_hashes([w[:k] + b"*" if len(w) > k else b"" for w in found.vocabulary]))
        none = tk.word_hashes([b""])[0]
        value = np.concatenate([h[code] for h in hashes])
        owner = np.tile(doc, len(hashes))
        real = value != none
        order = np.lexsort((value[real], owner[real]))
        self.doc, self.value = owner[real][order], value[real][order]
        first = np.append(True, (np.diff(self.doc) != 0) | (self.value[1:] != self.value[:-1]))[: len(self.doc)]
        self.doc, self.value = self.doc[first], self.value[first]

    def votes(self, lexicons: dict[str, np.ndarray], patterns: bool = True) -> np.ndarray:
        """1 for, 0 abstains: a row for each document, a column for each voter but the last."""
        out = []
        for lexicon in lexicons.values():
            hits = np.bincount(self.doc[_inside(self.value, lexicon)], minlength=self.n)
            out += [hits > 0, hits >= 2, (hits > 0) & (100 * hits >= self.sizes)]
        for pattern, needed in PATTERNS.values() if patterns else ():
            seek, found = re.compile(pattern), np.zeros(self.n, bool)
            for d in np.unique(self.doc[_inside(self.value, _hashed(needed))]).tolist():
                found[d] = bool(seek.search(self.data[self.offsets[d] : self.offsets[d + 1]].decode("utf-8", "replace").lower()))
            out.append(found)
        return np.stack(out, axis=1).astype(np.int32)


def mined_lexicons(own: list[np.ndarray], toxic: np.ndarray, parts: int = 4, chance: float = 0.05) -> dict[str, np.ndarray]:
    """Features that stand in toxic rows too often for chance, dealt into several lexicons so that no single voter holds them all.

    A feature that `c` toxic rows and no other have would do so by chance with probability
    prior ** c; that, times the number of features tried, has to stay below `chance`.
    """
    bad, n_bad = np.unique(np.concatenate([o for o, y in zip(own, toxic, strict=True) if y]), return_counts=True)
    n_good = np.zeros(len(bad), np.int64)
    for o, y in zip(own, toxic, strict=True):
        if not y:
            at = np.minimum(np.searchsorted(bad, o), len(bad) - 1)
            np.add.at(n_good, at[bad[at] == o], 1)
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    least = max(3, int(np.ceil(np.log(chance / max(1, int((n_bad >= 3).sum()))) / np.log(n[1] / sum(n)))))
    ratio = ((n_bad + 0.1) / n[1]) / ((n_good + 0.1) / n[0])
    chosen = bad[(n_bad >= least) & (ratio >= 150)]
    return {f"mined_{k}": np.sort(chosen[k::parts]) for k in range(parts) if len(chosen[k::parts])}


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels, accuracies and weights of the voters.

    P(vote | label) is a table of three by two for each voter.  Voters start out better than
    chance, which settles which of the two classes is the toxic one.  Weights below one stand
    for correlations: a voter counts by one over the sum of its squared residual correlations.
    """
    n, m = votes.shape
    table = np.full((m, 3, 2), 1 / 3)
    table[:, 2], table[:, 0], table[:, 1] = (0.1, 0.6), (0.6, 0.1), (0.3, 0.3)
    weight = np.ones(m)
    index = votes + 1
    posterior = np.full(n, prior)
    for _ in range(rounds):
        logs = np.log(table)
        score = np.log(prior / (1 - prior)) + sum(weight[j] * (logs[j, index[:, j], 1] - logs[j, index[:, j], 0]) for j in range(m))
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        for v in range(3):
            is_v = index == v
            table[:, v, 1] = (posterior @ is_v + 0.5) / (posterior.sum() + 1.5)
            table[:, v, 0] = ((1 - posterior) @ is_v + 0.5) / ((1 - posterior).sum() + 1.5)
        expected = np.outer(posterior, table[:, 2, 1] - table[:, 0, 1]) + np.outer(1 - posterior, table[:, 2, 0] - table[:, 0, 0])
        left = votes - expected
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-6
        correlation = (left.T @ left) / n / np.outer(spread, spread)
        weight = 1 / np.maximum(1, (np.clip(correlation, 0, 1) ** 2).sum(axis=1))
    accuracy = prior * table[:, 2, 1] + (1 - prior) * table[:, 0, 0]
    return posterior, accuracy, weight


def _fit_linear(x: list[np.ndarray], dense: np.ndarray, target: np.ndarray, size: int, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on posterior labels; x[i] holds the numbers of the features that row i has."""
    counts = np.array([len(v) for v in x])
    columns = np.concatenate(x) if counts.sum() else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(x)), counts)
    coef, dense_coef, bias = np.zeros(size), np.zeros(dense.shape[1]), 0.0
    sums = [np.full(size, 1e-3), np.full(dense.shape[1], 1e-3), 1e-3]
    share = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    for _ in range(rounds):
        margin = np.bincount(rows, coef[columns], len(x)) + dense @ dense_coef + bias
        error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(x)
        steps = [np.bincount(columns, error[rows], size) + 1e-6 * coef, dense.T @ error + 1e-6 * dense_coef, error.sum()]
        for k, g in enumerate(steps):
            sums[k] = sums[k] + np.square(g)
        coef -= rate * steps[0] / np.sqrt(sums[0])
        dense_coef -= rate * steps[1] / np.sqrt(sums[1])
        bias -= rate * steps[2] / np.sqrt(sums[2])
    return coef, dense_coef, bias


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: the rows that may be learnt from, (id, label 0 or 1); at most max_rows of them are used."""
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    lexicons = {k: _hashed(v) for k, v in LEXICONS.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                own = Features(part.column("text"))
                values = tk.listed(own.value.view(np.int64), np.bincount(own.doc, minlength=own.n), pa.int64())
                columns = [part.column("_id"), part.column("_y").cast(pa.int32()), values, pa.array(own.sizes, pa.int64()), pa.array(list(own.votes(lexicons)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_y", "features", "n_words", "votes"])

    got = chosen.mapInArrow(gather, "_id bigint, _y int, features array<bigint>, n_words bigint, votes array<int>").orderBy(F.xxhash64("_id"), "_id").limit(max_rows).toArrow().combine_chunks()
    if not got.num_rows:
        return _untrained(lexicons)
    toxic = got["_y"].to_numpy().astype(int)
    lists = got["features"].chunk(0)
    flat, cuts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    own = [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    single = _one_of_each_kind(own)
    own, toxic = [own[k] for k in single], toxic[single]
    if toxic.min() == toxic.max():
        return _untrained(lexicons)
    mined = mined_lexicons(own, toxic)
    sizes = got["n_words"].to_numpy()[single]
    votes = []
    for lexicon in mined.values():
        hits = np.array([_inside(o, lexicon).sum() for o in own])
        votes += [hits > 0, hits >= 2, (hits > 0) & (100 * hits >= sizes)]
    first = np.array([got["votes"][int(k)].as_py() for k in single], np.int32)
    built_in = 3 * len(lexicons)
    votes = np.concatenate([first[:, :built_in], *(v[:, None].astype(np.int32) for v in votes), first[:, built_in:]], axis=1)
    votes = np.column_stack([votes, -(votes.max(axis=1) == 0).astype(np.int32)])
    lexicons = lexicons | mined
    posterior, accuracy, weight = fit_label_model(votes, float(np.clip(toxic.mean(), 0.02, 0.5)))
    words = np.unique(np.concatenate(list(lexicons.values())))
    features = []
    for o in own:
        known = o[_inside(o, words)]
        features.append(np.searchsorted(words, known))
    coef, voter_coef, bias = _fit_linear(features, (votes > 0).astype(float), posterior, len(words))
    return Model(_voter_names(lexicons), accuracy, weight, lexicons, words, coef, voter_coef, float(bias))


def _one_of_each_kind(own: list[np.ndarray]) -> np.ndarray:
    """Places of rows, near copies once: rows count as alike if their four smallest features agree."""
    seen, out = set(), []
    for k, values in enumerate(own):
        least = values[:4].tobytes()
        if least not in seen or not least:
            seen.add(least)
            out.append(k)
    return np.array(out, np.int64)


def _untrained(lexicons: dict[str, np.ndarray]) -> Model:
    names = _voter_names(lexicons)
    return Model(names, np.full(len(names), 0.8), np.ones(len(names)), lexicons, np.zeros(0, np.uint64), np.zeros(0), np.full(len(names), 4.0), -3.0)


def _scores(own: Features, model: Model) -> tuple[np.ndarray, np.ndarray]:
    votes = own.votes(model.lexicons)
    known = _inside(own.value, model.words)
    linear = np.bincount(own.doc[known], model.coef[np.searchsorted(model.words, own.value[known])], own.n) if known.any() else 0.0
    margin = model.bias + votes @ model.voter_coef[: votes.shape[1]] + linear
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30))), votes


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in 0..1, and the names of the voters that voted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                scores, votes = _scores(Features(part.column("text")), model)
                names = [[model.voters[k] for k in np.flatnonzero(v)] for v in votes]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "score", "voters"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, voters array<string>")


def flagged(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxic_score") -> DataFrame:
    """All rows and columns of docs, and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                yield part.append_column(out_col, pa.array(_scores(Features(part.column(text_col)), model)[0], pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def below(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that score less than the cut."""
    name = tk.free("_score", docs.columns)
    return flagged(docs, model, text_col, name).where(F.col(name) < cut).drop(name)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on the labelled rows whose id is not held out, then score all documents."""
    model = fit(docs, labels.where(~tk.held_out(F.col(id_col))), max_rows, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).withColumn("held_out", tk.held_out(F.col("doc_id")))
