"""Counts, listings and stages of maps, on small maps with known answers and against plain walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import graphs, paths, roads, stages
from trailweave.plans import pilot
from trailweave.sources.tables import exits

OK, BAD = "=completed", "=failed"


def rows(maps):
    return pilot.exit_rows(maps)


def chain(n, first=1, last=OK, labels=("true", "false")):
    """n decisions in a row, all sides of which go on."""
    return {f"J{i}": ("if", dict.fromkeys(labels, f"J{i + 1}" if i < first + n - 1 else last)) for i in range(first, first + n)}


def plain_paths(of):
    """All paths of a map, by a walk in the order of exits; of: its rows."""
    by = {}
    for r in sorted(of, key=lambda r: r[5]):
        by.setdefault(r[2], []).append(r)
    edge = {r[1]: r for r in of}
    out, steps = [], []

    def walk(r):
        _, _, _, _, _, _, _, kind, to, only = r
        if kind == "dead":
            return
        if kind == "end":
            out.append((list(steps), to))
            return
        nexts = [edge[to]] if kind == "retry" else [e for e in by.get(to, []) if not e[6] and (only is None or e[1] == only)]
        for e in nexts:
            if e[1] not in steps:
                steps.append(e[1])
                walk(e)
                steps.pop()

    walk(edge["START"])
    return out


def random_maps(n, seed):
    """Decisions whose exits lead on, end, or lead nowhere; roads limited to an exit, and loops."""
    rng = np.random.default_rng(seed)
    maps = {}
    for w in range(n):
        size = int(rng.integers(1, 8))
        of = {}
        for i in range(1, size + 1):
            to = lambda: f"J{rng.integers(i + 1, size + 1)}" if i < size and rng.random() < 0.75 else str(rng.choice([OK, BAD, "!"], p=[0.6, 0.3, 0.1]))  # noqa: E731, B023
            of[f"J{i}"] = ("if", {x: to() for x in ("true", "false", "other")[: rng.integers(1, 4)]})
        if size > 3 and rng.random() < 0.5:  # a loop whose body is the next two decisions
            at = int(rng.integers(1, size - 2))
            after = f"J{at + 3}" if at + 3 <= size else OK
            of[f"J{at}"] = ("loop", {"iterate": f"J{at + 1}", "exit": after, "retry": f"J{at}"})
            of[f"J{at + 1}"] = ("if", {"true": f"J{at + 2}", "false": BAD})
            of[f"J{at + 2}"] = ("if", {"true": f"~J{at}", "false": after})
            for i in range(1, at):  # its body is entered by the loop alone
                of[f"J{i}"] = (of[f"J{i}"][0], {x: f"J{at}" if y in (f"J{at + 1}", f"J{at + 2}") else y for x, y in of[f"J{i}"][1].items()})
        elif size > 2 and rng.random() < 0.4:
            of["J1"] = ("if", {"true": "J3!true", "false": "J2"})
            of["J3"] = ("if", {"true": of["J3"][1].get("true", OK), "false": OK})
        maps[f"w{w}"] = of
    return maps


def of_workflows(all_rows):
    by = {}
    for r in all_rows:
        by.setdefault(r[0], []).append(r)
    return by


@pytest.fixture(scope="module")
def random_rows():
    return rows(random_maps(40, 3))


def test_counts_and_listings_equal_plain_walks(spark, random_rows):
    e = exits(spark, random_rows)
    want = {w: plain_paths(of) for w, of in of_workflows(random_rows).items()}
    assert {r.workflow: int(r.paths) for r in roads.path_counts(e).collect()} == {w: len(p) for w, p in want.items()}
    none = spark.createDataFrame([], "workflow string, edge_id string, name string, value string")
    for cap in (2000, 3):
        got = {}
        listed, groups = paths.pruned(e, none, cap)
        assert groups.count() == 0
        for r in listed.orderBy("workflow", "number").collect():
            got.setdefault(r.workflow, []).append((r.steps, r.end))
            assert r.number == len(got[r.workflow]) and r.truncated == (len(want[r.workflow]) > cap)
        assert got == {w: p[:cap] for w, p in want.items() if p}


def test_counts_without_exits_and_of_any_length(spark):
    e = exits(spark, rows({"long": chain(20, labels=[f"c{i}" for i in range(20)]), "other": chain(3)}))
    assert {r.workflow: r.paths for r in roads.path_counts(e).collect()} == {"long": str(20**20), "other": "8"}
    skip = spark.createDataFrame([("long", "J7.c3"), ("other", "J1.true"), ("other", "J1.false")], "workflow string, edge_id string")
    assert {r.workflow: r.paths for r in roads.path_counts(e, skip).collect()} == {"long": str(20**19 * 19), "other": "0"}


def test_reachable_exits(spark):
    e = exits(spark, rows({"a": {"J1": ("if", {"true": "J3!true", "false": "!"}), "J2": ("if", {"true": OK}), "J3": ("if", {"true": OK, "false": BAD})}}))
    assert sorted(r.edge_id for r in roads.reachable(e).collect()) == ["J1.false", "J1.true", "J3.true"]
    below = spark.createDataFrame([("a", "J:J3")], "workflow string, place string")
    assert sorted(r.edge_id for r in roads.reachable(e, below).collect()) == ["J3.false", "J3.true"]


def test_gates(spark):
    cases = {
        "early end": ({"J1": ("errcheck", {"ok": "J2", "err": BAD}), "J2": ("if", {"a": OK, "b": OK})}, ["J1", "J2"]),
        # a decision that some roads pass by is none; what they meet at is
        "by-pass": ({"J1": ("if", {"true": "J2", "false": "J3"}), "J2": ("if", {"true": "J3", "false": OK}), "J3": ("if", {"true": OK})}, ["J1", "J3"]),
        # no gate inside a loop that goes round, nor where a road allows one exit only
        "loop": (
            {"J1": ("loop", {"iterate": "J2", "exit": "J4", "retry": "J1"}), "J2": ("if", {"true": "J3", "false": BAD}), "J3": ("if", {"true": "~J1", "false": "J4"}), "J4": ("if", {"true": OK})},
            ["J1", "J4"],
        ),
        "limited": ({"J1": ("if", {"true": "J2!true", "false": "J2"}), "J2": ("if", {"true": "J3", "false": BAD}), "J3": ("if", {"true": OK})}, ["J1", "J3"]),
        # the order is that of the tree of dominators: what J2 dominates comes before J3, which J1 dominates
        "cross": ({"J1": ("if", {"true": "J2", "false": "J3"}), "J2": ("if", {"a": "J3", "b": "J4"}), "J3": ("if", {"true": OK}), "J4": ("if", {"true": OK})}, ["J1", "J4", "J3"]),
    }
    got = {}
    for r in stages.gates(exits(spark, rows({name: of for name, (of, _) in cases.items()}))).orderBy("stage").collect():
        got.setdefault(r.workflow, []).append(r.junction_id)
    assert got == {name: want for name, (_, want) in cases.items()}


def cut(found):
    got = {}
    for r in found.orderBy("stage").collect():
        got.setdefault(r.workflow, []).append((r.entry, r.next, int(r.paths), r.big))
    return got


def test_stages_of_large_maps(spark):
    early = {f"J{i}": ("if", {"a": f"J{i + 1}", "b": BAD}) for i in (1, 2, 3)}
    e = exits(spark, rows({"row": chain(24), "early": {**early, **chain(20, 4)}}))
    assert cut(stages.stages(e)) == {
        "row": [("J1", "J9", 256, False), ("J9", "J17", 256, False), ("J17", None, 256, False)],
        "early": [("J1", "J11", 3 + 2**7, False), ("J11", "J19", 2**8, False), ("J19", None, 2**5, False)],
    }


@pytest.mark.parametrize("most", [4, 16])
def test_stages_add_up(spark, random_rows, most):
    """Ways of stages are as many as counted, go on to where a stage begins, and make up the paths; each path's pieces are ways."""
    e = exits(spark, random_rows + rows(pilot.MAPS))
    all_rows = of_workflows(random_rows + rows(pilot.MAPS))
    found = stages.stages(e, most)
    listed = stages.stage_paths(e, found, most)
    of = stages.stage_map(e, stages.members(e, found))
    runs = paths.listed(e, 20000).select("workflow", "steps", "end", F.lit(1).alias("runs"))
    cut_ = runs.join(of, "workflow").select("workflow", "steps", F.explode(stages.pieces(F.col("steps"), F.col("end"), F.col("of"))).alias("p")).collect()
    ways, heads = {}, {}
    for r in listed.collect():
        ways.setdefault((r.workflow, r.stage), {})[r.key] = r
    for r in found.collect():
        heads.setdefault(r.workflow, {})[r.stage] = r
        if r.big:
            assert int(r.paths) > most
        else:
            assert int(r.paths) == len(ways.get((r.workflow, r.stage), {})) <= most
    for r in cut_:
        if not heads[r.workflow][r.p.stage].big:
            key = " ".join(r.p.steps) + "|" + (">" if r.p.end is None else r.p.end)
            assert key in ways[r.workflow, r.p.stage], (r, ways[r.workflow, r.p.stage].keys())
    for w, of_stage in heads.items():
        if any(s.big for s in of_stage.values()):
            continue
        to = {r[1]: r[8] for r in all_rows[w]}
        begins = {s.entry: k for k, s in of_stage.items()}

        def count(k, w=w, to=to, begins=begins):
            return sum(1 if r.end is not None else count(begins[to[r.steps[-1]]]) for r in ways.get((w, k), {}).values())

        assert count(0) == len(plain_paths(all_rows[w]))


def test_runs_beyond_the_list_count_in_stages(spark):
    e = exits(spark, rows({"a": chain(12)}))
    found = stages.stages(e, 16)
    listed = stages.stage_paths(e, found, 16)
    of = stages.stage_map(e, stages.members(e, found))
    last = [f"J{i}.false" for i in range(1, 13)]  # the last of 4,096 paths
    runs = spark.createDataFrame([("a", last, "completed", 3)], "workflow string, steps array<string>, end string, runs long")
    classes = spark.createDataFrame([("a", 0, "J1.true J2.true J3.true J4.true|>", "cannot-be-tested"), ("a", 2, " ".join(last[8:]) + "|completed", "cannot-be-tested")], "workflow string, stage long, key string, bucket string")
    results = stages.stage_results(listed, runs, of, classes)
    assert [(r.stage, r.key, r.runs) for r in results.where("covered").orderBy("stage").collect()] == [(0, " ".join(last[:4]) + "|>", 3), (1, " ".join(last[4:8]) + "|>", 3), (2, " ".join(last[8:]) + "|completed", 3)]
    totals = stages.stage_totals(found, results, e).orderBy("stage").collect()
    assert [(r.paths, r.covered, r.testable, r.big) for r in totals] == [("16", 1, 15, False), ("16", 1, 16, False), ("16", 1, 16, False)]


def test_pruned_listing(spark):
    """x is asked twice: the second answer must be the first."""
    of = {"J1": ("if", {"true": "J2", "false": "J2"}), **chain(3, 2, "J5"), "J5": ("if", {"true": "J6", "false": "J6"}), "J6": ("if", {"true": OK, "false": BAD})}
    e = exits(spark, rows({"a": of, "b": chain(2)}))
    facts = spark.createDataFrame([("a", "J1.true", "x", "1"), ("a", "J1.false", "x", "0"), ("a", "J5.true", "x", "1"), ("a", "J5.false", "x", "0")], "workflow string, edge_id string, name string, value string")
    listed, groups = paths.pruned(e, facts)
    assert listed.where("workflow = 'a'").count() == 32 and listed.where("workflow = 'b'").count() == 4
    got = groups.collect()
    assert len(got) == 16 and {(r.name, r.paths) for r in got} == {("x", "2")} and all(r.prefix[-1] in ("J5.true", "J5.false") for r in got)
    total = roads.path_counts(e).where("workflow = 'a'").first().paths
    assert 32 + sum(int(r.paths) for r in got) == int(total)
    # the list fills with paths that can be taken, and groups before its end are told
    listed, groups = paths.pruned(e, facts, cap=3)
    rows_ = listed.where("workflow = 'a'").orderBy("number").collect()
    assert [r.steps[0] + " " + r.steps[4] + " " + r.steps[5] for r in rows_] == ["J1.true J5.true J6.true", "J1.true J5.true J6.false", "J1.true J5.true J6.true"]
    assert all(r.truncated for r in rows_) and groups.count() == 1


def test_written_tables_are_not_taken_for_small_by_their_files(spark):
    """Maps' rows are up to a hundred times as large as the file that holds them, by which Spark would send them to the driver."""
    from trailweave.sources.rounds import SENT_VALUES, kept

    def plan(rows, more):
        table = kept(spark.range(rows).select(F.lit("a workflow of a long name").alias("workflow"), (F.col("id") % 7).alias("stage"), more.alias("more")).repartition(2))
        other = spark.range(SENT_VALUES).select(F.lit("a workflow of a long name").alias("workflow"), F.col("id").alias("stage"))
        both = other.join(table.where("stage = 3").distinct(), ["workflow", "stage"])
        return both.count(), both._jdf.queryExecution().executedPlan().toString()

    for rows, more, sent in [(700, F.lit(1), True), (700, F.sequence(F.lit(1), F.lit(SENT_VALUES // 700)), False), (SENT_VALUES // 3 + 1, F.lit(1), False), (0, F.lit(1), True)]:
        found, made = plan(rows, more)
        assert found == min(rows, 1)
        if rows:
            assert ("BroadcastHashJoin" in made) == sent and ("SortMergeJoin" in made) == (not sent)


def test_no_answer_for_all_maps_is_sent(spark):
    from trailweave.operators import alike

    names = spark.createDataFrame([("a", "a"), ("b", "a")], "workflow string, like string")
    found = alike.for_all(spark.createDataFrame([("a", 1)], "workflow string, n int"), names)
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stage_hits_are_ways_of_their_stages(spark):
    """What runs took, without a listing, is what the listing marks as covered; big stages' hits are told, too."""
    maps = {"a": chain(9), "b": {"J1": ("if", {"true": "J2", "false": "J3"}), "J2": ("if", {"true": "J3", "false": BAD}), "J3": ("if", {"true": OK, "false": BAD})}}
    all_rows = rows(maps)
    e = exits(spark, all_rows)
    found = stages.stages(e, 4)
    of = stages.stage_map(e, stages.members(e, found))
    taken = [(w, steps, end, n + 1) for w in maps for n, (steps, end) in enumerate(plain_paths([r for r in all_rows if r[0] == w])[::3])]
    runs = spark.createDataFrame(taken, "workflow string, steps array<string>, end string, runs long")
    columns = ["workflow", "stage", "key", "runs"]
    listed = stages.stage_results(stages.stage_paths(e, found, 4), runs, of).where("covered").select(*columns)
    hits = stages.stage_hits(runs, of).join(found.where("not big"), ["workflow", "stage"]).select(*columns)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, listed.collect())) != []
    per_stage = stages.stage_hits(runs, of).where("workflow = 'a'").groupBy("stage").agg(F.sum("runs").alias("n")).collect()
    assert {r.n for r in per_stage} == {sum(n for w, *_, n in taken if w == "a")}


def test_stage_runs_lists_no_ways(spark, monkeypatch):
    from trailweave.plans import queries

    monkeypatch.setattr(stages, "stage_paths", None)
    held = []
    monkeypatch.setattr(queries.stages, "stage_hits", lambda runs, of, hits=stages.stage_hits: held.append(runs) or hits(runs, of))
    found = queries.stage_runs(spark, "/root/testdata/sf0.001")
    assert found.columns == ["workflow", "stage", "key", "runs"] and found.count() > 0 and len(held) == 1


def test_stage_totals_looks_into_capped_maps_only(spark, monkeypatch):
    """Neither ways nor runs of maps whose paths are all listed are made."""
    from trailweave.plans import queries
    from trailweave.plans.adapters import customer_exits

    sf, seen = "/root/testdata/sf0.001", {}

    def noted(name, at):
        whole = getattr(stages, name)

        def run(*given):
            seen[name] = {r[0] for r in given[at].select("workflow").distinct().collect()}
            return whole(*given)

        monkeypatch.setattr(stages, name, run)

    noted("stage_paths", 0)
    noted("stage_results", 1)
    found = {r.workflow for r in queries.stage_totals(spark, sf).collect()}
    counts = {r.workflow: int(r.paths) for r in roads.path_counts(customer_exits(spark, sf)).collect()}
    capped = {w for w, n in counts.items() if n > paths.CAP}
    assert found == capped and 0 < len(capped) < len(counts)
    assert seen["stage_paths"] <= capped and seen["stage_results"] <= capped
