"""Finding what is wrong with the structure of conversations, and the cheapest repair.

A conversation is well formed if the initials of its roles match `(s?(ua)+)?`.
Its rows are kept (0), given the other role (1), or deleted (2; blank and
repeated rows have to be), and empty rows may be inserted (5); a truncated row
that stays costs 5 more.

The repair is a weighted automaton over the kinds of rows, determinised lazily:
what a suffix of rows costs from each of the four places in the pattern is a
vector; less its minimum it is one of few, and becomes a state.  The step from a
state over a kind of row is worked out once and kept in a table, so that a scan
from the last row to the first is one look-up a row and gives the cost.  A trace
back over the scan, from the first row to the last, follows tight arcs, of
several always the least letter (D, I, K, R), and gives the audit.

Rows are ordered by ranges and sorted part by part; a conversation is cut into
blocks of at most BLOCK rows, one byte a row, and the scan and the trace pass
from block to block.  The digest of a repaired conversation is sequential by its
definition: its rows stream through one task, which keeps only the hash's state.

Defined cases: a null role or text is one space, as is a null id or turn in the
damage's key; rows stand by turn, nulls first, then role, then text; a null
conversation is one like others; empty tables have no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.order import in_order

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_BITS = 12
WHITE = "\t\n\x0b\x0c\r "
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, CUT, DOOMED = 0, 4, 8
#: Places in the pattern: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ROLES = ("system", "user", "assistant")
#: Where a role leads from each place; None where it may not stand.
STEP = ((AFTER_S, None, None, None), (AFTER_U, AFTER_U, None, AFTER_U), (None, None, AFTER_A, None))
#: The role that goes on from each place.
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by rule: of 20 remainders of a checksum one drops a row, one empties it, one takes its stops, one doubles it and one makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("_k"))
    kind = F.col("_k")
    rows = rows.where(kind != 0).withColumn("text", F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")))
    return rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))).drop("_c", "_k")


class Automaton:
    """The determinised repair: vectors of costs to the end, numbered as they turn up, and steps between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, str, int]] = {}

    def number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.steps.append([None] * 12)
        return self.numbers[vector]

    def arcs(self, q: int, kind: int, after: tuple[int, ...]) -> list[tuple[str, int, int, str]]:
        """What may be done with a row of a kind at place q, but for insertions: letter, cost to the end, next place, and what is written."""
        out = [("D", DELETE + after[q], q, "")]
        if kind < DOOMED:
            extra = TRUNCATED if kind >= CUT else 0
            role = kind % 4
            if role != OTHER and STEP[role][q] is not None:
                to = STEP[role][q]
                out.append(("K", KEEP + extra + after[to], to, "k"))
            to = STEP[NEXT[q]][q]
            out.append(("R", REROLE + extra + after[to], to, "UA"[NEXT[q] - 1]))
        return out

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row of a kind, and what is taken off its vector."""
        if self.steps[state][kind] is None:
            after = self.vectors[state]
            cost = [min(a[1] for a in self.arcs(q, kind, after)) for q in range(4)]
            for _ in range(2):
                cost = [min(cost[q], INSERT + cost[STEP[NEXT[q]][q]]) for q in range(4)]
            least = min(cost)
            self.steps[state][kind] = self.number(tuple(c - least for c in cost)), least
        return self.steps[state][kind]

    def move(self, after: int, kind: int, q: int) -> tuple[str, str, int]:
        """The tight arcs of least letters from place q over a row of a kind: their letters, what they write, and the next place."""
        if (after, kind, q) not in self.moves:
            before, taken = self.step(after, kind)
            vector, at, letters, written = self.vectors[before], q, "", ""
            while True:
                arcs = [(x, c, to, w) for x, c, to, w in self.arcs(at, kind, self.vectors[after]) if c == vector[at] + taken]
                to = STEP[NEXT[at]][at]
                if INSERT + vector[to] == vector[at]:
                    arcs.append(("I", 0, to, "ua"[NEXT[at] - 1]))
                letter, _, at, new = min(arcs)
                letters, written = letters + letter, written + new
                if letter != "I":
                    break
            self.moves[after, kind, q] = letters, written or "-", at
        return self.moves[after, kind, q]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows one by one, and whether their conversation is another than that of the row before."""
    last: tuple = ()
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["conv_id"],) != last, row
            last = (row["conv_id"],)


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _scanned(id_type: pa.DataType):
    """Blocks of a conversation from the last to the first: the state after each, its cost, and neighbours that may not follow each other."""
    schema = pa.schema([("conv_id", id_type), ("block", pa.int64()), ("first_seq", pa.list_(pa.int64())), ("kinds", pa.binary()), ("after", pa.list_(pa.int32())), ("is_last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, out = Automaton(), []
        state = last = 0
        for begins, row in _groups(batches):
            if begins:
                state, last = automaton.number(END), -1
            kinds = bytes(row["kinds"])
            after, cost, illegal = automaton.vectors[state], 0, 0
            for kind in reversed(kinds):
                state, taken = automaton.step(state, kind)
                cost += taken
                illegal += last >= 0 and (kind % 4, last) not in legal
                last = kind % 4
            # the first block adds what its vector says of the start; the others add nothing
            out.append((row["conv_id"], row["block"], row["seqs"], kinds, after, begins, cost, illegal, automaton.vectors[state][START]))
            if len(out) == 2000:
                yield _flushed(out, schema, last_open=True)
                out = out[-1:]
        if out:
            yield _flushed(out, schema, last_open=False)

    def _flushed(rows: list[tuple], schema: pa.Schema, last_open: bool) -> pa.RecordBatch:
        done = []
        for k, row in enumerate(rows[:-1] if last_open else rows):
            first = k + 1 == len(rows) or rows[k + 1][5]
            done.append((*row[:6], row[6] + (row[8] if first else 0), row[7]))
        return _written(done, schema)

    return schema, run


def _traced(id_type: pa.DataType):
    """Blocks of a conversation from the first to the last: letters of the edits, and what is written at each row."""
    schema = pa.schema([("conv_id", id_type), ("block", pa.int64()), ("audit", pa.string()), ("seqs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, out, at = Automaton(), [], START
        for begins, row in _groups(batches):
            if begins:
                at = START
            kinds = bytes(row["kinds"])
            states = [automaton.number(tuple(row["after"]))]
            for kind in reversed(kinds):
                states.append(automaton.step(states[-1], kind)[0])
            letters, edits = [], []
            for kind, after in zip(kinds, states[-2::-1], strict=True):
                letter, written, at = automaton.move(after, kind, at)
                letters.append(letter)
                edits.append(written)
            if row["is_last"]:
                while END[at]:
                    letters.append("I")
                    edits[-1] += "ua"[NEXT[at] - 1]
                    at = STEP[NEXT[at]][at]
            out.append((row["conv_id"], row["block"], "".join(letters), row["first_seq"], edits))
            if len(out) == 2000:
                yield _written(out, schema)
                out = []
        if out:
            yield _written(out, schema)

    return schema, run


def _replayed(id_type: pa.DataType, digests: bool):
    """Rows of a conversation in order, each after what is to be done with it: repaired rows, or the digest of each conversation's."""
    rows_schema = pa.schema([("conv_id", id_type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    digest_schema = pa.schema([("conv_id", id_type), ("repaired_sha256", pa.string())])

    def lines(row: dict, edit: str) -> Iterator[tuple[str, str]]:
        for letter in edit:
            if letter in "ua":
                yield ROLES["sua".index(letter)], ""
            elif letter != "-":
                yield (row["role"] if letter == "k" else ROLES["SUA".index(letter)]), row["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        edit, place, open_id, hashing = "", 0, None, None
        for begins, row in _groups(batches):
            if begins:
                if hashing is not None and digests:
                    out.append((open_id, hashing.hexdigest()))
                place, open_id, hashing = 0, row["conv_id"], hashlib.sha256()
            if row["edit"] is not None:
                edit = row["edit"]
                continue
            for role, text in lines(row, edit):
                if digests:
                    hashing.update((b"\n" if place else b"") + f"{role}:{text}".encode())
                else:
                    out.append((row["conv_id"], place, role, text))
                place += 1
            if len(out) >= 1000:
                yield _written(out, digest_schema if digests else rows_schema)
                out = []
        if hashing is not None and digests:
            out.append((open_id, hashing.hexdigest()))
        if out:
            yield _written(out, digest_schema if digests else rows_schema)

    return (digest_schema if digests else rows_schema), run


class Repair:
    """What is wrong with conversations (conv_id, turn, role, text; none of role and text null) and their cheapest repair."""

    def __init__(self, rows: DataFrame):
        from pyspark.sql.pandas.types import to_arrow_type

        self.kind = dict(rows.dtypes)["conv_id"]
        self.id_type = to_arrow_type(rows.schema["conv_id"].dataType)
        first = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
        own = rows.select("conv_id", "turn", "role", "text")
        self.rows = in_order(own, [*first, F.substring("text", 1, 64)], [*first, F.col("text")], label="turns")
        self._blocks = self._judged()
        self._audits: DataFrame | None = None

    def _judged(self) -> DataFrame:
        from gridquarry.llm import textkit as tk

        trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
        told = self.rows.select("conv_id", "seq", "role", F.substring("role", 1, 1).alias("_i"), (trimmed == "").alias("_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("_cut"), F.sha2("text", 256).alias("_text"))
        first = told.where(~F.col("_blank")).groupBy("conv_id", "role", "_text").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
        met = told.drop("role", "_text").join(first, "seq", "left")
        fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
        role = F.when(F.col("_i") == "s", SYSTEM).when(F.col("_i") == "u", USER).when(F.col("_i") == "a", ASSISTANT).otherwise(OTHER)
        weight = F.when(F.col("_f").isin("blank", "duplicate"), DOOMED).when(F.col("_f") == "truncated", CUT).otherwise(FINE)
        met = met.withColumn("_f", fault).withColumn("_kind", role + weight)
        block = F.shiftright("seq", BLOCK_BITS).alias("block")
        counts = [F.count_if(F.col("_f") == c).alias(c) for c in ("blank", "duplicate", "truncated")]
        packed = met.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("seq", "_kind"))).alias("_r"), *counts)
        hexed = F.array_join(F.transform("_r", lambda x: F.lpad(F.hex(x["_kind"]), 2, "0")), "")
        blocks = packed.select("conv_id", "block", F.transform("_r", lambda x: x["seq"]).alias("seqs"), F.unhex(hexed).alias("kinds"), "blank", "duplicate", "truncated")
        return tk.stored(blocks, "blocks")

    def _scan(self) -> DataFrame:
        from pyspark.sql.pandas.types import from_arrow_schema

        schema, run = _scanned(self.id_type)
        dealt = self._blocks.select("conv_id", "block", "seqs", "kinds").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("block").desc())
        return dealt.mapInArrow(run, from_arrow_schema(schema))

    def _trace(self) -> tuple[DataFrame, DataFrame]:
        from pyspark.sql.pandas.types import from_arrow_schema

        from gridquarry.llm import textkit as tk

        if self._audits is None:
            self._scans = tk.stored(self._scan(), "scans")
            schema, run = _traced(self.id_type)
            dealt = self._scans.select("conv_id", "block", "first_seq", "kinds", "after", "is_last").repartition("conv_id").sortWithinPartitions("conv_id", "block")
            self._audits = tk.stored(dealt.mapInArrow(run, from_arrow_schema(schema)), "audits")
        return self._scans, self._audits

    def _replay(self, digests: bool) -> DataFrame:
        from pyspark.sql.pandas.types import from_arrow_schema

        _, audits = self._trace()
        schema, run = _replayed(self.id_type, digests)
        none = F.lit(None).cast("string")
        edits = audits.select("conv_id", F.explode(F.arrays_zip("seqs", "edits")).alias("_e")).select("conv_id", F.col("_e.seqs").alias("seq"), F.lit(0).alias("_o"), F.col("_e.edits").alias("edit"), none.alias("role"), none.alias("text"))
        both = edits.unionByName(self.rows.select("conv_id", "seq", F.lit(1).alias("_o"), none.alias("edit"), "role", "text"))
        dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "_o")
        return dealt.mapInArrow(run, from_arrow_schema(schema))

    def repaired(self) -> DataFrame:
        """conv_id, place, role, text: the repaired conversations."""
        return self._replay(False)

    def report(self, ids: DataFrame) -> DataFrame:
        """One row for each distinct conv_id of ids: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        scans, audits = self._trace()
        zero = lambda c: F.lit(None).cast("string" if c in ("audit", "repaired_sha256") else "bigint").alias(c)
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

        def part(frame: DataFrame, **told: Column | str) -> DataFrame:
            return frame.select("conv_id", *((F.col(told[c]) if isinstance(told[c], str) else told[c]).alias(c) if c in told else zero(c) for c in names))

        span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        turns = self.rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
        counts = self._blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        costs = scans.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
        pieces = audits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("_p")).withColumn("audit", F.array_join(F.transform("_p", lambda x: x["audit"]), ""))
        all_ = part(ids.select("conv_id").distinct())
        for more in (part(turns, gaps="gaps"), part(counts, blank="blank", duplicate="duplicate", truncated="truncated"), part(costs, cost="cost", illegal="illegal"), part(pieces, audit="audit"), part(self._replay(True), repaired_sha256="repaired_sha256")):
            all_ = all_.unionByName(more)
        empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
        return all_.groupBy("conv_id").agg(*(F.coalesce(F.max(c), empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in names))
