"""Structure repair against a plain search over edits, on damaged tables and on odd ones."""

import hashlib
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import structure

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """One conversation's report; rows after damage. From the end: the cheapest rest of the edits for each state."""
    digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
    seen, faults = set(), []
    for _, _, role, text in rows:
        core = text.strip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    after = lambda last: "a" if last == "u" else "u"

    @lru_cache(None)
    def rest(i, last, inserts):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
        else:
            role, fault = rows[i][2][:1], faults[i]
            cost, audit = rest(i + 1, last, 0)
            found.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                cost, audit = rest(i + 1, after(last), 0)
                found.append((cost + 3 + late, "R" + audit))
                if role == after(last) or (role == "s" and last == ""):
                    cost, audit = rest(i + 1, role, 0)
                    found.append((cost + late, "K" + audit))
        if inserts < 4:
            cost, audit = rest(i, after(last), inserts + 1)
            found.append((cost + 3, "I" + audit))
        return min(found, default=(10**9, ""))

    cost, audit = rest(0, "", 0)
    lines, i, last = [], 0, ""
    names = {"u": "user", "a": "assistant"}
    for e in audit:
        if e == "I":
            last = after(last)
            lines.append(names[last] + ":")
            continue
        if e == "R":
            last = after(last)
            lines.append(names[last] + ":" + rows[i][3])
        if e == "K":
            last = rows[i][2][0]
            lines.append(rows[i][2] + ":" + rows[i][3])
        i += 1
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def conversations(rows, change=damaged):
    by = {r[0]: [] for r in rows}
    for r in change(rows):
        by[r[0]].append(r)
    return {c: plain(x) for c, x in by.items()}


def as_dict(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No?", "half a", "", " \t", "What!\n", "x.y", "a.", "é。", "b!"]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    rows = []
    for c in range(n):
        for t in rng.choice(30, rng.integers(0, 9), replace=False).tolist():
            rows.append((c, t, str(rng.choice(roles, p=[0.35, 0.35, 0.15, 0.05, 0.05, 0.05])), str(rng.choice(texts))))
    return rows


def test_reports_equal_a_plain_search(spark):
    rows = random_rows(400, 5)
    df = spark.createDataFrame(rows, TURNS)
    got, want = as_dict(structure.reports(structure.damaged(df))), conversations(rows)
    assert got == {c: w[0] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(structure.repaired(structure.damaged(df)).collect(), key=lambda r: (r.conv_id, r.at)):
        assert r.at == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert dict(lines) == {c: w[1] for c, w in want.items() if w[1]}


def test_odd_rows(spark):
    long = "word " * 200_000 + "end."
    rows = [
        (None, None, None, None), (None, 0, "user", "a."), (None, 0, "user", "a."), (1, None, "user", "Hi."), (1, None, "assistant", "Yes."),
        (1, 2**62, "user", long), (1, -5, "assistant", long), (2, 0, None, "x."), (3, 0, "system", "s."), (3, 1, "system", "s."),
        (4, 7, "user", None), (5, 1, "", "."), (5, 2, "user", "日本\xa0"), *[(6, 3, "user", "same.")] * 40, *[(7, t, "assistant", "ok.") for t in range(300)],
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit(1)).withColumn("range", F.lit("x")).withColumn("audit", F.lit(2))
    assert as_dict(structure.reports(structure.damaged(df))) == {c: w[0] for c, w in conversations(rows).items()}
    undamaged = conversations(rows, lambda r: [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in r])
    assert as_dict(structure.reports(df)) == {c: w[0] for c, w in undamaged.items()}


def test_nothing_left_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 0), (1, 1, "user", "b.", 0), (2, 4, "user", "a.", 1)], TURNS + ", copies int")
    got = as_dict(structure.reports(df))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[2][5:7] == (3, "KI")
    assert structure.reports(df.where("false")).count() == structure.repaired(df.where("false")).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_long_conversation_is_cut_between_tasks(spark, partitions):
    rng = np.random.default_rng(9)
    rows = [(1, int(t), str(rng.choice(["user", "assistant"])), f"{rng.integers(50)}{rng.choice(['.', ''])}") for t in rng.integers(0, 700, 900)]
    rows += random_rows(20, 3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = as_dict(structure.reports(spark.createDataFrame(rows, TURNS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {c: w[0] for c, w in conversations(rows, lambda r: r).items()}


def test_a_layer_is_made_once_for_a_shared_prefix():
    trie = structure.Trie()
    signatures = sorted({"AB", "ABC", "ABD", "AB", "B", "ABCC", ""})
    for s in signatures:
        trie.answer(s)
    assert trie.layers_made == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
