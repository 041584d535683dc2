r"""Operator 12, repair of the structure of conversations: a dynamic program over a trie of signatures.

A sound conversation has the role initials (s?(ua)+)?, no blank turn, no turn twice and no text cut off before its
end. A turn is kept (cost 0), given the role user or assistant (3) or deleted (4; blank and repeated ones must be),
an empty turn of user or assistant is inserted anywhere (3), and a truncated turn that stays adds 3. Of the cheapest
repairs that with the least audit, the initials of the edits in order (D, I, K, R), is taken.

What the program needs of a turn is a letter: its role's initial and its first fault. A conversation is the string of
its letters, its signature. The distinct signatures are sorted; a task walks them as the paths of a prefix trie, with
the layers of the path it stands on, so a layer is computed once for all signatures that begin alike, and an answer is
given where a signature ends. A layer holds, for each state of the pattern that can be reached, the least cost and the
place of its audit among those of the others: as all of them cover the same turns and end with one, none begins
another, and their order is the order of all that follows.

The turns are numbered by a range partitioning, so that a conversation that holds a third of all rows is cut between
tasks; of it, a letter a turn meets in one row, as does its audit. Only the repaired turns of a conversation pass one
task, in order and one at a time, since a hash of its text is a chain.

Cases: a null role or text is one space; the turns of a null conv_id are one conversation. Turns lie in the order of
turn (null first), then role, then the digest of role and text. Repeated rows are duplicates, as are equal role and
text at another turn. `copies`, if there is such a column, says how often a row stands (0: not at all, but its
conversation is still reported, with zeros and an empty audit if nothing is left). Texts of any length pass whole.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import in_slices, sent, written

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INITIALS, FAULTS = "sua", ("sound", "blank", "duplicate", "truncated")
ROLES = {"u": "user", "a": "assistant"}
_LETTERS = "ABCDEFGHIJKLMNOP"  # 4 * initial (s, u, a, other) + fault
#: States of the pattern: nothing yet, after s, after u, after a.
_START, _S, _U, _A = range(4)
_AFTER = {_START: _U, _S: _U, _U: _A, _A: _U}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Layer = tuple[tuple[int, int], ...]


class Layers:
    """Layers of the program; the step from a layer by a letter is worked out once.

    A layer is (state, cost above the layer's least), in the order of the states' audits.
    """

    first: Layer = ((_START, 0),)

    def __init__(self) -> None:
        self.known: dict[tuple[Layer, str], tuple[Layer, int, dict[int, tuple[int, str]]]] = {}

    def step(self, layer: Layer, letter: str) -> tuple[Layer, int, dict[int, tuple[int, str]]]:
        """The next layer, what the least cost grows by, and for each state where it came from and by which edits."""
        if (layer, letter) in self.known:
            return self.known[layer, letter]
        initial, fault = divmod(_LETTERS.index(letter), 4)
        best: dict[int, tuple[int, int, str, int]] = {}

        def reach(to: int, cost: int, rank: int, edits: str, state: int) -> None:
            best[to] = min(best.get(to, (cost, rank, edits, state)), (cost, rank, edits, state))

        for rank, (state, cost) in enumerate(layer):
            at = state
            for edits in ("", "I", "II"):
                reach(at, cost + DELETE, rank, edits + "D", state)
                if FAULTS[fault] not in ("blank", "duplicate"):
                    stays = cost + TRUNCATED * (FAULTS[fault] == "truncated")
                    reach(_AFTER[at], stays + REROLE, rank, edits + "R", state)
                    if initial < 3 and (initial + 1 == _AFTER[at] or (initial, at) == (0, _START)):
                        reach(initial + 1, stays, rank, edits + "K", state)
                at, cost = _AFTER[at], cost + INSERT
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda to: best[to][1:3])
        found = tuple((to, best[to][0] - least) for to in order), least, {to: (best[to][3], best[to][2]) for to in best}
        self.known[layer, letter] = found
        return found


class Trie:
    """Answers on signatures in their order; `layers_made` counts the nodes that were entered."""

    def __init__(self) -> None:
        self.layers, self.before, self.layers_made = Layers(), "", 0
        # a node: layer, cost, how its states came about, (blank, duplicate, truncated, illegal), initial of its letter
        self.path: list[tuple] = [(Layers.first, 0, {}, (0, 0, 0, 0), None)]

    def answer(self, signature: str) -> tuple[int, int, int, int, int, str]:
        """blank, duplicate, truncated, illegal, cost and audit of a signature that is not less than the one before."""
        shared = 0
        for a, b in zip(signature, self.before):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for letter in signature[shared:]:
            layer, cost, _, counts, last = self.path[-1]
            found, grown, came = self.layers.step(layer, letter)
            initial, fault = divmod(_LETTERS.index(letter), 4)
            counts = [n + (k + 1 == fault) for k, n in enumerate(counts[:3])] + [counts[3]]
            counts[3] += last is not None and (last, initial) not in _LEGAL
            self.path.append((found, cost + grown, came, tuple(counts), initial))
            self.layers_made += 1
        self.before = signature
        layer, cost, _, counts, _ = self.path[-1]
        ends = {_START: "", _S: "II", _U: "I", _A: ""}
        more, _, state = min((c + INSERT * len(ends[s]), rank, s) for rank, (s, c) in enumerate(layer))
        audit = [ends[state]]
        for node in reversed(self.path[1:]):
            state, edits = node[2][state]
            audit.append(edits)
        return *counts, cost + more, "".join(reversed(audit))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for b in batches:
        rows = [(s, *trie.answer(s)) for s in b.column("signature").to_pylist()]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def audits(signatures: DataFrame) -> DataFrame:
    """signature, blank, duplicate, truncated, illegal, cost, audit of each distinct signature."""
    apart = signatures.select("signature").distinct()
    ordered = apart.repartitionByRange("signature").sortWithinPartitions("signature")
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    return ordered.mapInArrow(_answers, f"signature string, {counts}, audit string")


def _rows(turns: DataFrame) -> DataFrame:
    """turns without nulls in role and text, with copies and `key`, the digest of role and text."""
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.withColumn("key", key)


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, signature and gaps of each conversation of turns (conv_id, turn, role, text and maybe copies)."""
    tail = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(tail == "", 1).when(F.substring(tail, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))  # 1 to 3, 0 for others, 1 for no role at all
    initial = F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1)
    rows = _rows(turns).withColumn("fault", fault).withColumn("initial", initial)
    # equal rows of one turn are one row from here on; texts are left behind
    rows = rows.groupBy("conv_id", "turn", "role", "key").agg(F.min("initial").alias("initial"), F.min("fault").alias("fault"), F.sum("copies").alias("copies"))
    placed = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "key")
    rows = written(placed.withColumn("range", F.spark_partition_id()))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k"))
    several = several.agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(sent(several), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")

    def letter(fault: Column) -> Column:
        return F.substring(F.lit(_LETTERS), (4 * F.col("initial") + fault + 1).cast("int"), F.lit(1))

    seen = F.coalesce(place > F.col("_first"), F.lit(False))
    own = letter(F.when((F.col("fault") != 1) & seen, 2).otherwise(F.col("fault")))
    again = letter(F.when(F.col("fault") == 1, 1).otherwise(2))
    letters = F.when(F.col("copies") > 0, F.concat(own, F.repeat(again, (F.col("copies") - 1).cast("int")))).otherwise("")
    here = F.when(F.col("copies") > 0, F.col("turn"))
    in_order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "key", letters.alias("letters"), here.alias("here"))
    rows = rows.select("conv_id", "range", in_order.alias("row"))
    # what a range holds of a conversation, then the conversation: a letter a turn, and its turns as an interval
    segments = rows.groupBy("conv_id", "range").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    turns_here = F.array_distinct(F.filter("rows.here", lambda t: t.isNotNull()))
    segment = F.struct(
        "range", F.array_join("rows.letters", "").alias("letters"), F.array_min(turns_here).alias("lo"),
        F.array_max(turns_here).alias("hi"), F.size(turns_here).cast("long").alias("n"),
    )
    whole = segments.select("conv_id", segment.alias("segment")).groupBy("conv_id")
    whole = whole.agg(F.array_sort(F.collect_list("segment")).alias("segments"))
    spans = F.filter("segments", lambda s: s["n"] > 0)
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("n"))

    def joined(so_far: Column, s: Column) -> Column:  # two ranges may share the turn at their border
        shared = F.coalesce((so_far["hi"] == s["lo"]).cast("long"), F.lit(0).cast("long"))
        return F.struct(
            F.coalesce(so_far["lo"], s["lo"]).alias("lo"), s["hi"].alias("hi"), (so_far["n"] + s["n"] - shared).alias("n")
        )

    gaps = F.aggregate(spans, start, joined, lambda x: F.coalesce(F.try_subtract(x["hi"], x["lo"]) + 1 - x["n"], F.lit(0)))
    return whole.select("conv_id", F.array_join("segments.letters", "").alias("signature"), gaps.alias("gaps"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str]]:
    """Walks conversations, each its head (with the audit) and then its turns: (head, "", "") at a head, then (None, role,
    text) for each turn of the repaired conversation, and (None, "", "") at the end of a batch's rows."""
    audit, at, last = "", 0, ""

    def inserted() -> Iterator[tuple[None, str, str]]:
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            last = "a" if last == "u" else "u"
            at += 1
            yield None, ROLES[last], ""

    for b in batches:
        for row in b.to_pylist():
            if row["head"] is not None:
                yield from inserted()
                audit, at, last = row["head"]["audit"], 0, ""
                yield {"conv_id": row["conv_id"], **row["head"]}, "", ""
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    last = "a" if last == "u" else "u"
                    yield None, ROLES[last], row["text"]
                elif edit == "K":
                    last = row["role"][0]
                    yield None, row["role"], row["text"]
    yield from inserted()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    rows: list[list] = []
    so_far, any_yet = hashlib.sha256(), False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for head, role, text in _edited(in_slices(batches)):
        if head is None:
            so_far.update(f"{chr(10) * any_yet}{role}:{text}".encode())
            any_yet = True
            continue
        if rows:
            rows[-1].append(so_far.hexdigest())
        if len(rows) >= 1000:
            yield out()
            rows = []
        rows.append([head[n] for n in names[:-1]])
        so_far, any_yet = hashlib.sha256(), False
    if rows:
        rows[-1].append(so_far.hexdigest())
        yield out()


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "at", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []
    conv, at, held = None, 0, 0
    for head, role, text in _edited(in_slices(batches)):
        if head is not None:
            conv, at = head["conv_id"], 0
            continue
        rows.append((conv, at, role, text))
        at, held = at + 1, held + len(text)
        if len(rows) >= 1000 or held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _with_heads(turns: DataFrame) -> DataFrame:
    """Each conversation's head, with its counts and its audit, and then its turns, a conversation a task."""
    whole = written(signatures(turns))
    found = whole.join(sent(audits(whole)), "signature")
    head = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    rows = _rows(turns).where("copies > 0")
    rows = rows.select("conv_id", F.lit(None).cast("struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>").alias("head"), "turn", "role", "key", "text", "copies")
    heads = found.select("conv_id", head.alias("head"), *(F.lit(None).alias(n) for n in ("turn", "role", "key", "text", "copies")))
    both = heads.unionByName(rows).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "key")


def reports(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    turns: conv_id, turn, role, text and maybe copies. gaps: turn numbers that are missing between the least and the
    largest; illegal: neighbours whose initials are not su, ua or au; the hash is that of the repaired turns as lines of
    role:text.
    """
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return _with_heads(turns).mapInArrow(_hashed, f"conv_id long, {counts}, audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text: the turns of the repaired conversations; one with none left gives no row."""
    return _with_heads(turns).mapInArrow(_as_rows, "conv_id long, at long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns as crc32 of "conv_id:turn" (null: one space) mod 20 damages them: 0 takes a row away (copies 0), 1 empties
    its text, 2 takes its . ! ? away, 3 doubles it, 4 gives it the role user."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
