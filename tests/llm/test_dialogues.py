"""Repairs of conversations against the cheapest of all edits, found one by one."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from gridquarry.llm import dialogues
from gridquarry.llm.queries import op12_conversation_repair

WHITE = "\t\n\x0b\x0c\r "


def fault(rows, k):
    role, text = rows[k]
    if not text.strip(WHITE):
        return "blank"
    if rows[k] in rows[:k]:
        return "duplicate"
    return None if text.rstrip(WHITE)[-1] in ".!?" else "truncated"


def cheapest(rows):
    """(cost, letters, repaired rows): the least over all ways to read the rows, the repaired roles so far being all that counts."""
    faults = [fault(rows, k) for k in range(len(rows))]
    legal = lambda seen, initial: re.fullmatch(r"s?(ua)*u?", seen + initial) is not None

    # of what was written only the end matters
    shorter = lambda seen: "ua" if seen.endswith("a") else seen[-1:]

    @lru_cache(maxsize=None)
    def rest(k, seen, inserted):
        out = []
        if k == len(rows) and (seen == "" or seen.endswith("a")):
            out.append((0, "", ()))
        if k < len(rows):
            c, a, w = rest(k + 1, seen, 0)
            out.append((c + 2, "D" + a, w))
            if faults[k] not in ("blank", "duplicate"):
                extra = 5 if faults[k] else 0
                role, text = rows[k]
                for letter, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name[:1] and legal(seen, name[0]):
                        c, a, w = rest(k + 1, shorter(seen + name[0]), 0)
                        out.append((c + cost + extra, letter + a, ((name, text), *w)))
        if inserted < 2:
            for name in ("user", "assistant"):
                if legal(seen, name[0]):
                    c, a, w = rest(k, shorter(seen + name[0]), inserted + 1)
                    out.append((c + 5, "I" + a, ((name, ""), *w)))
        return min(out, default=(10**9, "", ()))

    return rest(0, "", 0)


def plain(conversations):
    """What the query is to return, by conv_id."""
    rows = {}
    for conv, turn, role, text in conversations:
        mine = rows.setdefault(conv, [])
        told = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        said = [(r, t) for _, r, t in own]
        faults = [fault(said, k) for k in range(len(said))]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit, repaired = cheapest(said)
        lines = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((str(conv), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out)


def invented(n, seed):
    random.seed(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "again.", None, "é…", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "u2", "User"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    return [(c if c else None, t if random.random() > 0.1 else None, random.choices(roles, weights)[0], random.choice(texts) if random.random() < 0.6 else f"{t} and {random.random()}.") for c in range(n) for t in range(random.randint(1, 9))]


KINDS = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, KINDS).selectExpr("*", "1 seq", "'x' block").write.parquet(str(tmp_path / name / "conversations.parquet"))
    return sorted((str(r.conv_id), *(r[c] for c in NAMES)) for r in op12_conversation_repair(spark, str(tmp_path / name)).collect())


def test_query_equals_all_edits_tried(spark, tmp_path):
    rows = invented(150, 1)
    rows += rows[:20]
    assert report(spark, rows, tmp_path, "a") == plain(rows)
    assert report(spark, [], tmp_path, "b") == []


def test_blocks_pass_their_state_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dialogues, "BLOCK_BITS", 2)
    rows = [(7, t, random.choice(["user", "assistant", "system"]), f"{t % 31}.") for t in range(60)] + invented(30, 2)
    assert report(spark, rows, tmp_path, "c") == plain(rows)


def test_repaired_rows_are_well_formed(spark):
    rows = dialogues.damaged(spark.createDataFrame(invented(80, 3), KINDS))
    found = {}
    for r in dialogues.Repair(rows).repaired().collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role))
    for own in found.values():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role in sorted(own)))


def test_automaton_is_small_and_lazy():
    automaton = dialogues.Automaton()
    state = automaton.number(dialogues.END)
    random.seed(4)
    for _ in range(20_000):
        state, _ = automaton.step(state, random.randrange(12))
    assert len(automaton.vectors) < 200
