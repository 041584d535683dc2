"""Words of the automaton equal the different sequences of external steps of listed paths."""

from pyspark.sql import functions as F

from test_stages import plain_paths, random_maps
from trailweave.operators import words
from trailweave.plans import pilot
from trailweave.sources.tables import exits


def outside(rows, said, zero, steps, end):
    """A path's external steps, by a plain walk along it."""
    out, kind = [], {r[1]: (r[3], r[2], r[4]) for r in rows}
    for i, s in enumerate(steps):
        out += said.get(s, [])
        if s in zero and f"{kind[s][1]}.iterate" not in steps[:i]:
            out += zero[s]
    return (*out, f"end: {end}")


def test_words_equal_grouped_paths(spark):
    maps = {**random_maps(25, 8), **pilot.MAPS}
    rows = pilot.exit_rows(maps)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    external, want = [], {}
    for w, of in by.items():
        if w in pilot.MAPS:
            said, zero = pilot.STEPS[w], {e: [z[0]] for e, z in pilot.ZERO_ROUNDS.get(w, {}).items()}
        else:  # two names for all exits, some say nothing, some twice
            said = {r[1]: [[], ["s"], ["t"], ["s", "t"]][(i * 7) % 4] for i, r in enumerate(of) if r[1] != "START" and not r[6]}
            zero = {r[1]: ["none"] for r in of if r[3] == "loop" and r[4] == "exit"}
        external += [(w, e, said.get(e, []), zero.get(e, [])) for e in sorted({*said, *zero})]
        want[w] = {outside(of, said, zero, steps, end) for steps, end in plain_paths(of)}
    e = exits(spark, rows)
    x = spark.createDataFrame(external, "workflow string, edge_id string, steps array<string>, zero array<string>")
    assert {r.workflow: int(r.scenarios) for r in words.scenario_counts(e, x).collect()} == {w: len(s) for w, s in want.items()}
    got = {}
    for r in words.scenario_words(e, x).collect():
        assert not r.truncated
        got.setdefault(r.workflow, set()).add(tuple(r.steps))
    assert got == {w: s for w, s in want.items() if s}
    few = words.scenario_words(e, x, most=2).groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.bool_or("truncated").alias("t")).collect()
    assert {r.workflow: (r.n, r.t) for r in few} == {w: (min(2, len(s)), len(s) > 2) for w, s in want.items() if s}
    large = {r.workflow for r in words.scenario_counts(e, x, 3).where("scenarios is null").collect()}
    assert large and "orders.OrderWorkflow" not in large
