"""DuckDB SQL of the coverage queries, formulated on its own: windows and self-joins instead of folds."""

from __future__ import annotations

from trailweave.plans import pilot

RUNS = """
ev as (
  select user_id, ts::date as day, ts, event_id, value,
         case event_type when 'view' then 'J1.iterate' when 'signup' then 'J1.exit' when 'click' then 'J2.click' when 'error' then 'J2.error' else 'J3.true' end as step
  from events),
runs as (
  select case when user_id % 17 = 0 then 'ghost' else 'shopper' end as workflow, user_id || '/' || day as run_id,
         case when user_id % 10 = 9 then '' else 'Segment' || (user_id % 10) end as test,
         case when (user_id + day(day)) % 9 = 0 then 'running' else 'complete' end as status,
         case when user_id % 13 = 0 then 'old' else 'now' end as hash, user_id % 5 + 1 as recorder,
         list(step order by ts, event_id) as steps
  from ev group by user_id, day),
single as (
  select workflow, run_id, i, steps[i] as step, case when i > 1 then steps[i - 1] end as prev, len(steps) as n
  from runs, unnest(range(1, len(steps) + 1)) t(i)),
judged as (
  select *, case when prev is null or prev = 'J2.click' then step in ('J1.iterate', 'J1.exit')
                 when prev = 'J1.iterate' then step in ('J2.click', 'J2.error')
                 when prev = 'J1.exit' then step in ('J3.true', 'J3.false') else false end as legal
  from single),
ended as (
  select workflow, run_id, min(i) filter (not legal) as bad, arg_max(step, i) as last,
         min(i) filter (step = 'J1.iterate') as f, max(i) filter (step = 'J1.iterate') as l
  from judged group by workflow, run_id),
matches as (
  select r.*, r.workflow = 'shopper' as known,
         r.workflow = 'shopper' and bad is null and last in ('J2.error', 'J3.true', 'J3.false') as matched,
         case when r.workflow = 'shopper' then case when bad is not null then bad when last in ('J2.error', 'J3.true', 'J3.false') then null else 0 end end as bad_step,
         case when last = 'J2.error' then 'failed' else 'completed' end as maybe_end, f, l
  from runs r join ended using (workflow, run_id)),
kinds as (
  select *, case when not known then 'unknown' when status <> 'complete' then 'incomplete' when hash <> 'now' then 'stale' when not matched then 'unmatched' else 'counted' end as kind,
         case when matched then list_filter(list_transform(range(1, len(steps) + 1), lambda i: case when f is null or i < f or i >= l then steps[i] end), lambda s: s is not null) end as path
  from matches),
counted as (select * from kinds where kind = 'counted')
"""

ORDERS = """
flags as (select l_orderkey, list(l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) as steps from lineitem group by 1),
order_runs as (
  select o_orderpriority as workflow, o_orderkey as order_id, coalesce(steps, []) as steps, o_orderstatus as end_kind,
         substr(sha256(array_to_string(coalesce(steps, []), ' ') || '|' || o_orderstatus), 1, 10) as path_id
  from orders left join flags on o_orderkey = l_orderkey),
paths as (
  select workflow, path_id, any_value(steps) as steps, any_value(end_kind) as end_kind, count(*) as runs, bool_or(order_id % 3 = 0) as covered, bool_or(order_id % 2 = 0) as had
  from order_runs group by workflow, path_id)
"""

RULED = (
    ORDERS
    + """,
hits as (
  select workflow, path_id, unnest(list_filter([
    case when list_contains(steps, 'R') and list_contains(steps, 'A') and not list_contains(steps, 'N') then 'rule:many-returns' end,
    case when list_contains(steps, 'N') and not list_contains(steps, 'R') and not list_contains(steps, 'A') then 'rule:no-return' end,
    case when (list_contains(steps, 'R') or list_contains(steps, 'A')) and list_contains(steps, 'N') then 'rule:known' end], lambda x: x is not null)) as source
  from paths),
verdicts as (
  select *, case source when 'rule:many-returns' then 'cannot-be-tested' when 'rule:no-return' then 'needs-review' else 'needs-special-test' end as bucket,
         case source when 'rule:many-returns' then 'rule' when 'rule:no-return' then 'unexplained' else 'known-defect' end as label
  from hits),
classified as (
  select p.*, case when covered or v.source is null then 'testable' else v.bucket end as bucket, case when covered or v.source is null then 'default' else v.label end as label,
         case when covered or v.source is null then 'default' else v.source end as source
  from paths p left join verdicts v using (workflow, path_id))
"""
)


def _values() -> str:
    def text(x: object) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in pilot.exit_rows())
    return f"exits(workflow, edge_id, junction_id, kind, label, ord, is_retry, to_kind, to_id, only_edge) as (values {rows})"


MAP = (
    _values()
    + """,
walks as (
  select workflow, to_kind, to_id, []::varchar[] as steps, []::int[] as way from exits where edge_id = 'START'
  union all
  select w.workflow, e.to_kind, e.to_id, w.steps || [e.edge_id], w.way || [e.ord]
  from walks w join exits e on e.workflow = w.workflow and not list_contains(w.steps, e.edge_id)
    and ((w.to_kind = 'junction' and e.junction_id = w.to_id and not e.is_retry) or (w.to_kind = 'retry' and e.edge_id = w.to_id))),
listed as (
  select workflow, row_number() over (partition by workflow order by way) as number, steps, to_id as end_kind, substr(sha256(array_to_string(steps, ' ') || '|' || to_id), 1, 10) as path_id
  from walks where to_kind = 'end'),
pairs as (
  select distinct a.workflow, a.edge_id as first, b.edge_id as second
  from exits a join exits b on a.workflow = b.workflow
  where a.edge_id <> 'START' and not a.is_retry and not b.is_retry
    and ((a.to_kind = 'junction' and b.junction_id = a.to_id) or (a.to_kind = 'retry' and b.label = 'exit' and b.junction_id = split_part(a.to_id, '.', 1))))
"""
)


def _runs_values() -> str:
    rows = ", ".join(f"('{w}', '{t}', ['" + "', '".join(s.split(",")) + "'])" for w, t, s in pilot.RUNS)
    return f"pilot_runs(workflow, test, steps) as (values {rows})"


PILOT = (
    MAP
    + ","
    + _runs_values()
    + """,
-- a folded run is the listed path that ends with the run's last trip: drop what lies between the first and the last iteration
numbered as (select workflow, test, i, steps[i] as step from pilot_runs, unnest(range(1, len(steps) + 1)) t(i)),
turns as (select *, min(case when step = 'J1.iterate' then i end) over (partition by workflow, test) as f, max(case when step = 'J1.iterate' then i end) over (partition by workflow, test) as l from numbered),
folded as (select workflow, test, list(step order by i) as steps from turns where f is null or i < f or i >= l group by workflow, test),
results as (select l.*, exists (select 1 from folded r where r.workflow = l.workflow and r.steps = l.steps) as covered from listed l),
ran_pairs as (
  select distinct workflow, kept[i] as first, kept[i + 1] as second
  from (select workflow, list_filter(steps, lambda s: not s like '%.retry') as kept from folded), unnest(range(1, len(kept))) t(i))
"""
)

#: Customers' orders as decisions: skip may pass by the next one, early may fail, both goes on either way. One is a gate unless
#: the one before it may pass it by. Ways from a gate to where a stage stops are counted backwards; stages grow up to 64 ways.
CUSTOMERS = """o as (
  select o_custkey::varchar as workflow, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i,
    count(*) over (partition by o_custkey) as n,
    case when o_orderpriority = '5-LOW' then 'skip' when o_orderstatus = 'O' then 'early' else 'both' end as sort
  from orders),
led as (select *, lag(sort) over (partition by workflow order by i) as before from o),
gates as (
  select workflow, i, n, row_number() over (partition by workflow order by i) - 1 as number
  from led where i = 1 or not (before = 'skip' and i < n))"""
STAGES = CUSTOMERS + """,
stops as (
  select workflow, number - 1 as until, i as stop from gates where number > 0
  union all select workflow, max(number), max(n) + 1 from gates group by workflow),
walk(workflow, until, stop, i, c, after) as (
  select workflow, until, stop, stop, 1::hugeint, 1::hugeint from stops
  union all
  select w.workflow, until, stop, w.i - 1, case sort when 'skip' then c + after when 'early' then c + 1 else 2 * c end, c
  from walk w join o on o.workflow = w.workflow and o.i = w.i - 1),
counted as (select g.workflow, number, until, stop, c from gates g join walk w on w.workflow = g.workflow and w.i = g.i where until >= number),
ends as (
  select workflow, number, coalesce(min(until) filter (until > number and c > 64) - 1, max(until)) as until from counted group by all),
runs(workflow, stage, number, until) as (
  select workflow, 0, number, until from ends where number = 0
  union all select r.workflow, stage + 1, e.number, e.until from runs r join ends e on e.workflow = r.workflow and e.number = r.until + 1),
staged as (
  select r.workflow, stage, g.i as first_i, c.stop as next_i, g.n, c.c as ways, c.c > 64 as big
  from runs r join gates g using (workflow, number) join counted c using (workflow, number, until))"""
#: Runs of customers' maps and the pieces of their paths in each stage.
STAGE_RUNS = STAGES + """,
taken as (
  select workflow, i, n, sort, r, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = r and l_returnflag = 'R') as second
  from o, range(1, 8) t(r)),
road(workflow, r, i, to_i) as (
  select workflow, r, i, case when second and sort = 'early' then -1 when second and sort = 'skip' then i + 2 else i + 1 end from taken where i = 1
  union all
  select t.workflow, t.r, t.i, case when t.second and t.sort = 'early' then -1 when t.second and t.sort = 'skip' then t.i + 2 else t.i + 1 end
  from road p join taken t on t.workflow = p.workflow and t.r = p.r and t.i = p.to_i),
piece as (
  select s.workflow, s.stage, r, string_agg('J' || i || case when second then '.second' else '.first' end, ' ' order by i) as steps, max_by(to_i, i) as last, any_value(s.next_i) as next_i, any_value(s.n) as n
  from road join taken using (workflow, r, i) join staged s on s.workflow = road.workflow and i >= first_i and i < next_i where not big group by all),
hits as (
  select workflow, stage, steps || '|' || case when last = -1 then 'failed' when last > n then 'completed' else '>' end as key, count(*) as runs from piece group by all)"""

ORACLES: dict[str, str] = {
    "trace_paths": f"with {ORDERS} select workflow, order_id, array_to_string(steps, ' ') as steps, path_id from order_runs",
    "match_runs": f"with {RUNS} select workflow, run_id, known, matched, coalesce(bad_step, -1)::int as bad_step, case when matched then maybe_end end as end, case when matched then array_to_string(path, ' ') end as path from kinds",
    "mismatch_causes": f"""with {RUNS}
      select case when bad_step = 0 then 'stopped before an end' when steps[bad_step - 1] in ('J2.error', 'J3.true', 'J3.false') then 'went on after an end' else 'left out or repeated a decision' end as cause, count(*) as runs
      from kinds where known and not matched group by 1""",
    "trace_triage": f"with {RUNS} select workflow, kind, count(*) as runs from kinds group by all",
    "unmatched_groups": f"""with {RUNS} select workflow, 't1:' || substr(sha256(array_to_string(steps, chr(10))), 1, 12) as steps_id, array_to_string(steps, ' ') as steps, count(*) as runs, min(bad_step)::int as bad_step
      from kinds where kind = 'unmatched' group by workflow, kinds.steps""",
    "path_listing": f"with recursive {MAP} select workflow, number::int as number, array_to_string(steps, ' ') as steps, end_kind as end, path_id from listed",
    "legal_pairs": f"with recursive {MAP} select * from pairs",
    "path_counts": f"with recursive {MAP} select workflow, count(*)::varchar as paths from listed group by workflow",
    "reachable_exits": f"with recursive {MAP} select distinct workflow, unnest(steps) as edge_id from listed",
    "pilot_coverage": f"""with recursive {PILOT}
      select * from (select workflow, count(*) as paths, count(*) filter (covered) as covered, 100.0::double * count(*) filter (covered) / count(*) as percent,
               case when 2 * count(*) filter (covered) < count(*) then 'High' when 5 * count(*) filter (covered) > 4 * count(*) then 'Low' else 'Medium' end as priority from results group by workflow)
      join (select workflow, count(*) as branches, count(t.edge_id) as taken from exits left join (select distinct workflow, step as edge_id from numbered) t using (workflow, edge_id) where edge_id <> 'START' group by workflow) using (workflow)
      join (select workflow, count(*) as pairs, count(r.first) as pairs_covered from pairs p left join ran_pairs r using (workflow, first, second) group by workflow) using (workflow)""",
    "path_coverage": f"""with {RUNS}, five(steps, end_kind) as (values ('J1.iterate J2.click J1.exit J3.true', 'completed'), ('J1.iterate J2.click J1.exit J3.false', 'completed'), ('J1.iterate J2.error', 'failed'), ('J1.exit J3.true', 'completed'), ('J1.exit J3.false', 'completed'))
      select 'shopper' as workflow, substr(sha256(s.steps || '|' || s.end_kind), 1, 10) as path_id, s.steps, s.end_kind as end, count(c.run_id) as runs, count(c.run_id) > 0 as covered
      from five s left join counted c on array_to_string(c.path, ' ') = s.steps group by s.steps, s.end_kind""",
    "exits_taken": f"""with {RUNS} select workflow, edge_id, count(*) as taken_raw, coalesce(any_value(n), 0) as taken_folded
      from (select workflow, unnest(steps) as edge_id from counted) left join (select workflow, edge_id, count(*) as n from (select workflow, unnest(path) as edge_id from counted) group by all) using (workflow, edge_id) group by all""",
    "decision_pairs": f"with {RUNS} select workflow, path[i] as first, path[i + 1] as second, count(*) as runs from counted, unnest(range(1, len(path))) t(i) group by all",
    "prefix_tree": f"with {ORDERS} select workflow, array_to_string(steps[1:i], ' ') as prefix, sum(runs)::bigint as runs from paths, unnest(range(1, len(steps) + 1)) t(i) group by all",
    "missed_groups": f"""with {RUNS}, five(number, steps) as (values (1, ['J1.iterate', 'J2.click', 'J1.exit', 'J3.true']), (2, ['J1.iterate', 'J2.click', 'J1.exit', 'J3.false']), (3, ['J1.iterate', 'J2.error']), (4, ['J1.exit', 'J3.true']), (5, ['J1.exit', 'J3.false'])),
      missed as (select * from five where steps not in (select path from counted) and number <> 2),
      cut as (select number, steps, max(i) as n from missed, unnest(range(0, len(steps) + 1)) t(i) where i = 0 or exists (select 1 from counted c where c.path[1:i] = missed.steps[1:i]) group by all),
      grouped as (select array_to_string(steps[1:n], ' ') as prefix, steps[n + 1] as step, count(*) as missed, min(number) as number from cut group by all)
      select 'shopper' as workflow, prefix, step, missed, row_number() over (order by missed desc, number)::int as rank from grouped""",
    "test_uniqueness": f"""with {RUNS}, named as (select case when test = '' then '(test name not recorded)' else test end as test, workflow, path from counted),
      e as (select distinct test, unnest(path) as item from named), p as (select distinct test, list_filter(path, lambda s: not starts_with(s, 'J3')) as item from named),
      eu as (select min(test) as test, count(*) over () from e group by item having count(*) = 1), pu as (select min(test) as test from p group by item having count(*) = 1),
      rows as (select n.test, count(*) as runs, count(distinct workflow) as workflows, (select count(*) from e where e.test = n.test) as branches, (select count(*) from eu where eu.test = n.test) as unique_branches,
        (select count(*) from p where p.test = n.test) as scenarios, (select count(*) from pu where pu.test = n.test) as unique_scenarios from named n group by n.test)
      select *, test <> '(test name not recorded)' and unique_branches = 0 and unique_scenarios = 0 as adds_nothing from rows""",
    "loop_rounds": f"""with {RUNS}, per_run as (select run_id, len(list_filter(steps, lambda s: s = 'J1.iterate')) as n, list_contains(steps, 'J1.exit') as left_ from counted),
      found as (select case when n = 0 then '0' when n = 1 then '1' else '2+' end as bucket, count(*) as entries from per_run where n > 0 or left_ group by 1)
      select 'shopper' as workflow, 'J1' as junction_id, bucket, coalesce(entries, 0)::bigint as entries, coalesce(entries, 0) > 0 as seen from (values ('0'), ('1'), ('2+')) b(bucket) left join found using (bucket)""",
    "condition_coverage": """with w as (select case when user_id % 17 = 0 then 'ghost' else 'shopper' end as workflow, 'c:' || (event_id % 7) as condition_id, value > 20 as v from events where user_id % 5 + 1 >= 4),
      seen as (select distinct workflow, condition_id, v from w),
      atoms as (select workflow, 'c:' || i as condition_id from (values ('shopper'), ('ghost')) n(workflow), unnest(range(9)) t(i))
      select a.workflow, count(distinct a.condition_id) as atoms, count(s.v) as seen, 18::bigint as total, case when a.workflow in (select workflow from w) then 'recorded' else 'not recorded' end as status
      from atoms a left join seen s using (workflow, condition_id) group by a.workflow""",
    "rule_match": f"with {RULED} select workflow, path_id, source from hits",
    "classified_paths": f"with {RULED} select workflow, path_id, bucket, label, source, 0 as extra from classified",
    "bucket_breakdown": f"""with {RULED}, c as (select *, bucket in ('testable', 'needs-review') as counts from classified)
      select workflow, count(*) filter (bucket = 'testable') as testable, count(*) filter (bucket = 'testable' and covered) as testable_covered, count(*) filter (bucket = 'needs-review') as needs_review, count(*) filter (bucket = 'needs-review' and covered) as needs_review_covered,
        count(*) filter (bucket = 'needs-special-test') as needs_special_test, count(*) filter (bucket = 'needs-special-test' and covered) as needs_special_test_covered, count(*) filter (bucket = 'cannot-be-tested') as cannot_be_tested,
        count(*) filter (bucket = 'cannot-be-tested' and covered) as cannot_be_tested_covered, count(*) filter (counts) as counted_paths, count(*) filter (counts and covered) as counted_covered, 100.0::double * count(*) filter (counts and covered) / count(*) filter (counts) as counted_percent
      from c group by workflow""",
    "contradictory_paths": f"with {ORDERS} select workflow, path_id, 'contradictory' as label from paths where list_contains(steps, 'R') and list_contains(steps, 'A')",
    "rule_suggestions": f"""with {RULED}, review as (select * from classified where bucket = 'needs-review'),
      every as (select workflow, count(*) as paths, list_filter([case when bool_and(list_contains(steps, 'A')) then 'A' end, case when bool_and(list_contains(steps, 'N')) then 'N' end, case when bool_and(list_contains(steps, 'R')) then 'R' end], lambda x: x is not null) as decisions from review group by workflow)
      select workflow, paths, array_to_string(decisions, ' ') as decisions, len(decisions) > 0 and not exists (select 1 from classified c where c.workflow = e.workflow and c.bucket <> 'needs-review' and list_has_all(c.steps, e.decisions)) as hits_only from every e""",
    "outcome_status": f"""with {RULED}, through as (select distinct workflow, path_id, covered, bucket, label, runs, unnest(steps) as edge from classified)
      select workflow, 'b:' || substr(sha256(concat_ws(chr(10), 'b1', 'orders', workflow, 'flag', edge, '1')), 1, 12) as branch_id, 1::bigint as sites, max((covered and runs > 40)::int)::bigint as sites_taken, count(*) filter (not covered) as missed_paths,
        case when bool_or(covered and runs > 40) then 'covered' when bool_or(bucket <> 'cannot-be-tested' and label <> 'known-defect') then 'missed' when bool_or(label = 'known-defect') then 'blocked' else 'impossible' end as status
      from through group by workflow, edge""",
    "scenario_groups": f"""with {RULED}, s as (select *, ('0x' || substr(path_id, 1, 8))::bigint as number, 'sc:' || substr(sha256(array_to_string(list_filter(steps, lambda x: x <> 'N') || ['end: ' || end_kind], chr(31))), 1, 10) as scenario_id,
        case bucket when 'testable' then 0 when 'needs-review' then 1 when 'needs-special-test' then 2 else 3 end as rank, workflow <> '5-LOW' or len(steps) <= 4 as listed from classified),
      g as (select workflow, scenario_id, count(*) filter (listed) as path_count, coalesce(min(number) filter (listed and covered), min(number) filter (listed), -1) as main_number,
          min_by(label, (rank, number)) filter (listed) as own, min(rank) filter (listed) as rank, coalesce(sum(runs) filter (covered), 0)::bigint as runs, bool_or(covered) as covered from s group by workflow, scenario_id)
      select workflow, scenario_id, path_count, main_number, runs, covered,
        case when covered then 'testable' when workflow = '5-LOW' and rank = 3 then 'needs-review' else ['testable', 'needs-review', 'needs-special-test', 'cannot-be-tested'][rank + 1] end as bucket,
        case when covered and coalesce(rank, 9) <> 0 then 'default' when workflow = '5-LOW' and rank = 3 then 'model-limit' else own end as label
      from g where path_count > 0 or (workflow = '5-LOW' and covered)""",
    "baseline_check": f"""with {RULED}, b as (select *, case when not had then '' when runs % 2 = 0 then 'cannot-be-tested' else bucket end as was, had and runs % 3 <> 0 as took from classified)
      select workflow, path_id, 'lost' as finding, was, bucket from b where took and not covered
      union all select workflow, path_id, 'untested', was, bucket from b where bucket = 'testable' and not covered and was <> 'testable'
      union all select workflow, path_id, 'review', was, bucket from b where bucket = 'needs-review' and was <> 'needs-review'""",
    "snapshot_diff": f"""with {ORDERS}, s as (select workflow, path_id, count(*) filter (order_id % 2 = 0) as a, count(*) filter (order_id % 2 = 1) as b from order_runs group by all)
      select workflow, path_id, case when a = 0 then 'new' when b = 0 then 'removed' else 'changed' end as change from s where a <> b""",
    "missed_ranking": f"""with {ORDERS}, m as (select workflow, steps, count(*) as missed_paths, len(steps) as line, 'Test' || len(steps) as base, ['cancel', 'compensation', 'activity failure', 'continue-as-new', 'timers and timeouts', 'signals and updates', 'plain logic', 'old version branches'][len(steps) % 8 + 1] as risk,
        sha256(workflow || '|' || array_to_string(steps, ' ')) as branch_id from paths where not covered group by workflow, steps),
      r as (select *, row_number() over (order by line % 8, missed_paths desc, line, branch_id) as rank from m),
      t as (select *, row_number() over (partition by base order by rank) as twin from r)
      select workflow, branch_id, risk, missed_paths, rank::int as rank, case when twin > 1 then base || '_' || twin else base end as name from t""",
    "tests_first": f"with {ORDERS} select workflow, coalesce(steps[1], '') as hint, count(*) as paths, count(*) as variants from paths where not covered group by 1, 2",
    "priority_grades": f"""with {ORDERS}, c as (select workflow, count(*) as paths, count(*) filter (covered) as covered from paths group by workflow)
      select *, 100.0::double * covered / paths as percent, case when 2 * covered < paths then 'High' when 5 * covered > 4 * paths then 'Low' else 'Medium' end as priority, (floor(covered * 1000.0::double / paths + 0.5) / 10)::double as main,
        case when 100.0 * covered / paths >= 90 then 'exemplary' when 100.0 * covered / paths >= 75 then 'commendable' when 100.0 * covered / paths >= 60 then 'acceptable' else 'needs work' end as grade from c""",
    "main_numbers": f"""with {RULED}, b as (select workflow, count(*) filter (bucket in ('testable', 'needs-review')) as paths, count(*) filter (bucket in ('testable', 'needs-review') and covered) as covered from classified group by workflow),
      k as (select *, case when workflow = '5-LOW' then 'branch' when workflow = '1-URGENT' then 'handler' when paths <= 100 then 'path' when paths <= 500 then 'scenario' else 'branch' end as kind from b),
      n as (select workflow, kind, case kind when 'handler' then 3 when 'branch' then 2 else covered end as covered, case kind when 'handler' then 4 when 'branch' then 3 else paths end as total from k)
      select workflow, kind, covered::bigint as covered, total::bigint as total, (floor(covered * 1000.0::double / total + 0.5) / 10)::double as percent, floor(covered * 1000.0::double / total + 0.5) / 10 >= 80 as met from n""",
    "ci_gates": f"""with {ORDERS}, c as (select workflow, count(*) as paths, count(*) filter (covered) as covered from paths group by workflow), v as (select 100.0::double * sum(covered) / sum(paths) as a, min(100.0::double * covered / paths) as b from c)
      select 'paths' as gate, a as value, 50.0::double as floor, a < 50 as failed from v union all select 'worst', b, 10.0::double, b < 10 from v""",
    "run_history": """with m as (select o_orderpriority as project, date_trunc('month', o_orderdate)::date as time, count(*) filter (o_orderstatus = 'F') as covered, count(*) as paths from orders group by 1, 2),
      last as (select * from m qualify row_number() over (partition by project order by time desc) <= 5)
      select project, time::varchar as time, covered, paths, coalesce(covered - lag(covered) over (partition by project order by time), 0) as change, coalesce(quarter(time) <> lag(quarter(time)) over (partition by project order by time), false) as new_scope from last""",
    "branch_sample": "select c_custkey::varchar as branch_id from customer order by sha256('decision-sample' || chr(10) || c_custkey::varchar), 1 limit 20",
    "scope_status": """select distinct p_type as workflow, case when length(p_type) % 2 = 0 then 'excluded' when p_type < 'M' then 'not included' else 'in scope' end as status, case when length(p_type) % 2 = 0 then 'even' else '' end as reason from part""",
    "handler_table": """with ran as (select event_type as handler, max(user_id % 3) as t from events where value > 30 group by 1), reg(handler, kind, branches, recordable) as (values ('view', 'signal', 2, true), ('click', 'update', 1, true), ('refund', 'query', 0, true), ('audit', 'validator', 3, false))
      select 'app' as workflow, handler, kind, branches, coalesce(t, 0)::bigint as branches_taken, case when t is not null then 'yes' when not recordable then 'not recorded' else 'no' end as exercised from reg left join ran using (handler)""",
    "call_outcomes": """with s(call, outcome, edge, place) as (values ('Send', 'success', 'NO', 1), ('Send', 'failure', 'RF', 2), ('Send', 'timeout', 'XX', 3), ('Bill', 'success', 'ZZ', 1), ('Bill', 'failure', 'AF', 2))
      select 'ship' as workflow, call, outcome, exists (select 1 from lineitem where l_returnflag || l_linestatus = edge) as seen, place from s""",
    "covered_stay_testable": f"with {RULED} select workflow, path_id from classified where covered and bucket <> 'testable'",
}

EVERY = (
    RULED
    + """,
has as (select *, list_contains(steps, 'R') as r, list_contains(steps, 'A') as a, list_contains(steps, 'N') as n, path_id[1] as d from paths),
said as (
  select workflow, path_id, 'override' as source, 0 as rank, 'needs-special-test' as bucket, 'known-defect' as label from has where d = '0'
  union all select workflow, path_id, 'comment', 1, 'cannot-be-tested', 'comment' from has where workflow = '1-URGENT' and r
  union all select workflow, path_id, source, 2, bucket, label from verdicts
  union all select workflow, path_id, 'closed-signal-channel', 3, 'needs-review', 'needs-review' from has where a
  union all select workflow, path_id, 'version-gate-old-branch', 5, 'needs-special-test', 'version-gate-old-branch' from has where n
  union all select workflow, path_id, 'history-limit', 6, case when n then 'needs-special-test' else 'needs-review' end, case when n then 'history-limit' else 'needs-review' end from has where n or r
  union all select workflow, path_id, 'contradictory', 7, 'cannot-be-tested', 'contradictory' from has where r and a
  union all select workflow, path_id, 'loop-exit-before-first-trip', 10, 'cannot-be-tested', 'impossible-loop-exit' from has where r and not n
  union all select workflow, path_id, 'value-flow', 12, 'cannot-be-tested', 'impossible-nil' from has where d in ('1', '2')
  union all select workflow, path_id, 'likely-defect', 15, 'needs-review', 'likely-defect' from has where d in ('3', '4')
  union all select workflow, path_id, 'unknown-input-type', 14, 'needs-review', 'unknown-input-type' from has where d = '5')
"""
)


def _settled(where: str = "true") -> str:
    return f"""{EVERY},
heard as (select * from said where {where}),
asked as (select * from heard h where rank < 12 or not exists (select 1 from heard o where o.workflow = h.workflow and o.path_id = h.path_id and o.rank < 12)),
ordered as (select *, row_number() over (partition by workflow, path_id order by rank, source, label) as nth from asked),
first as (select * from ordered where nth = 1),
further as (select workflow, path_id, string_agg(source, ' ' order by source) as extra from ordered where nth > 1 group by all),
settled as (
  select p.*, case when p.covered or v.source is null then 'testable' else v.bucket end as bucket, case when p.covered or v.source is null then 'default' else v.label end as label,
         case when p.covered or v.source is null then 'default' else v.source end as source, coalesce(f.extra, '') as extra
  from paths p left join first v using (workflow, path_id) left join further f using (workflow, path_id))
"""


#: Maps of orders: a walk goes from line to line and may end as failed at each returned one.
ORDER_MAPS = """
walked as (select l_orderkey::varchar as workflow, list(l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) as flags from lineitem group by 1),
ends as (
  select workflow, len(flags) + 1 as pos, list_transform(range(1, len(flags) + 1), lambda i: 'J' || i || '.next') as steps, 'completed' as end from walked
  union all
  select workflow, i, list_transform(range(1, i), lambda k: 'J' || k || '.next') || ['J' || i || '.back'], 'failed' from walked, unnest(range(1, len(flags) + 1)) t(i) where flags[i] = 'R')
"""

ORACLES |= {
    "every_source": f"with {_settled()} select workflow, path_id, bucket, label, source, extra from settled",
    "detectors_off": f"with {_settled("source not in ('contradictory', 'history-limit')")} select workflow, source, count(*) as paths from settled group by all",
    "possible_bugs": f"with {_settled()} select workflow, coalesce(steps[1], '') as place, count(*) as paths, min(path_id) as example from settled where label = 'likely-defect' group by all",
    "unused_rules": f"""with {RULED}, entries as (select distinct workflow, r.rule_id from paths, (values ('many-returns'), ('no-return'), ('known'), ('old')) r(rule_id))
      select workflow, rule_id from entries e where not exists (select 1 from hits h where h.workflow = e.workflow and h.source = 'rule:' || e.rule_id)""",
    "distrusted_claims": f"""with {_settled()}, placed as (select *, coalesce(list_position(steps, 'N'), 0) as uses from settled),
      doubted as (select *, bucket = 'cannot-be-tested' and source not in ('override', 'comment') and (uses = 0 or uses >= case when workflow < '3' then 2 else 3 end) as doubt from placed)
      select workflow, path_id, case when doubt then 'needs-review' else bucket end as bucket, case when doubt then 'model-limit' else label end as label from doubted""",
    "risk_tags": f"""with {ORDERS}, cut as (select *, case when list_contains(steps, 'N') then steps[list_position(steps, 'N') + 1:] else [] end as later from paths),
      more as (select *, case when list_contains(later, 'R') then later[list_position(later, 'R') + 1:] else [] end as after_failure from cut)
      select workflow, path_id, case when list_contains(after_failure, 'N') or list_contains(after_failure, 'R') then 'compensation' when list_contains(steps, 'R') then 'activity failure' when list_contains(steps, 'A') then 'timers and timeouts'
        when end_kind = 'P' then 'signals and updates' else 'plain logic' end as risk from more""",
    "outcome_summary": f"""with s as ({ORACLES["outcome_status"]}), c as (select workflow, count(*) filter (status <> 'impossible') as possible, count(*) filter (status = 'covered') as covered, count(*) filter (status = 'blocked') as blocked, count(*) filter (status = 'impossible') as impossible from s group by workflow)
      select *, case when possible = 0 then 0.0 else 100.0::double * covered / possible end as percent from c""",
    "acknowledged_groups": f"""with {RUNS}, g as (select workflow, 't1:' || substr(sha256(array_to_string(steps, chr(10))), 1, 12) as steps_id, count(*) as runs from kinds where kind = 'unmatched' group by workflow, kinds.steps)
      select *, right(steps_id, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') as explained from g""",
    "beyond_list": f"""with {RUNS} select workflow, array_to_string(path, ' ') as steps, maybe_end as end, count(*) as runs from counted
      where array_to_string(path, ' ') not in ('J1.iterate J2.click J1.exit J3.true', 'J1.iterate J2.click J1.exit J3.false') group by workflow, path, maybe_end""",
    "coverage_drops": f"""with {ORDERS}, c as (select workflow, 100.0::double * count(*) filter (covered) / count(*) as percent, 100.0::double * count(*) filter (had) / count(*) as was from paths group by workflow)
      select workflow, percent, was from c where was - percent > 0.5""",
    "gate_exit_code": f"with g as ({ORACLES['ci_gates']}) select case when bool_or(failed) then 2 else 0 end as code from g",
    "worst_first": f"""with {ORDERS}, c as (select workflow, count(*) filter (covered) as covered, count(*) as total, 100.0::double * count(*) filter (covered) / count(*) as percent from paths group by workflow)
      select *, percent >= 40 as met, row_number() over (order by percent >= 40, percent, total - covered desc, workflow)::int as place from c""",
    "branch_headline": f"""with {ORDERS}, e as (select workflow, edge, bool_or(covered and runs > 40) as took from (select workflow, covered, runs, unnest(steps) as edge from paths) group by all),
      w as (select workflow, count(*) as branches, count(*) filter (took) as taken from e group by workflow), t as (select sum(branches)::bigint as branches, sum(taken)::bigint as taken, count(*) filter (taken * 100.0 / branches >= 75) as at_target from w)
      select *, 100.0::double * taken / branches as percent, case when 100.0 * taken / branches >= 90 then 'exemplary' when 100.0 * taken / branches >= 75 then 'commendable' when 100.0 * taken / branches >= 60 then 'acceptable' else 'needs work' end as grade from t""",
    "forced_decisions": f"""with {ORDERS}, o as (select workflow, steps[1] as decision, steps[2] as outcome, bool_or(covered and runs > 20) as ran from paths where len(steps) > 1 group by all),
      t as (select a.workflow, a.decision, a.outcome, string_agg(b.outcome, ' ' order by b.outcome) as tests_of from o a join o b on a.workflow = b.workflow and a.decision = b.decision and b.ran and b.outcome <> a.outcome group by all) select * from t""",
    "decision_check": """with r as (select case when l_returnflag = 'R' then 'noticed' when l_returnflag = 'A' then 'survived' when l_quantity > 40 then 'flaky' else 'no visible effect' end as result from lineitem),
      c as (select count(*) filter (result = 'noticed') as noticed, count(*) filter (result = 'survived') as survived, count(*) filter (result = 'no visible effect') as no_visible_effect, count(*) filter (result = 'flaky') as flaky from r)
      select *, 100.0::double * noticed / (noticed + survived) as score from c""",
    "anchor_changes": "select p_partkey::varchar as rule_id, 1::int as entry, p_type as was, p_brand as \"is\" from part where p_partkey % 7 = 0 and p_type is distinct from p_brand",
    "unmarked_runs": f"with {ORDERS} select order_id, array_to_string(steps, ' ') as steps, order_id % 5 = 0 as bad from order_runs",
    "stated_assumptions": f"with {ORDERS} select assumption, count(*) as paths, count(distinct workflow) as workflows from (select workflow, unnest(list_distinct(steps)) as assumption from paths) group by 1",
    "order_maps": f"with {ORDER_MAPS} select workflow, count(*)::varchar as paths from ends group by workflow",
    "order_map_paths": f"with {ORDER_MAPS} select workflow, row_number() over (partition by workflow order by pos desc)::int as number, array_to_string(steps, ' ') as steps, \"end\" from ends",
    "stage_gates": f"with {CUSTOMERS} select workflow, 'J' || i as junction_id, number as stage from gates",
}

PART_ENTRIES = """
kinds as (select distinct p_brand as workflow, 'if ' || p_type as t, p_size % 3 as k from part),
numbered as (select *, row_number() over (partition by workflow, t order by k) as n from kinds),
outcomes as (
  select workflow, t || case when n > 1 then ' #' || n else '' end as decision, label from numbered, (values ('true'), ('false')) l(label)),
entry_forms as (
  select workflow, t, m, i as ord,
         case i when 0 then t || ' --true' when 1 then 'any: ' || t || ' --false' when 2 then t || ' #1 --true' when 3 then t || ' #2 --true'
                when 4 then t || ' #2/2 --false' when 5 then t || ' #1/3 --true' when 6 then t || '  #9 --false' else t || ' --maybe' end as entry,
         -- the decision meant, by the form and the number of decisions of this text
         case i when 0 then case when m = 1 then [t || '.true'] end
                when 1 then list_sort(list_transform(range(1, m + 1), lambda n: t || case when n > 1 then ' #' || n else '' end || '.false'))
                when 2 then [t || '.true']
                when 3 then case when m >= 2 then [t || ' #2.true'] end
                when 4 then case when m = 2 then [t || ' #2.false'] end
                when 5 then case when m = 3 then [t || '.true'] end end as edges,
         case i when 0 then case when m > 1 then 'ambiguous' end when 3 then case when m < 2 then 'unknown' end
                when 4 then case when m <> 2 then 'count changed' end when 5 then case when m <> 3 then 'count changed' end
                when 6 then 'unknown' when 7 then 'unknown' end as problem,
         case when i = 0 and m > 1 then list_sort(list_transform(range(1, m + 1), lambda n: t || case when n > 1 then ' #' || n else '' end || ' --true')) end as options
  from (select workflow, t, count(*) as m from numbered group by all), unnest(range(0, 8)) x(i))
"""

WORDED = (
    ORDERS
    + """,
worded as (select *, 's1:' || substr(sha256('s1' || chr(10) || array_to_string(list_transform(steps, lambda s: 'flag' || chr(31) || s), chr(10)) || '|' || end_kind), 1, 12) as stable_id from paths),
legacy as (
  select distinct workflow, path_id, 's1:' || substr(sha256('s1' || chr(10) || array_to_string(list_transform(list_filter(steps, lambda s: s <> 'N'), lambda s: 'flag' || chr(31) || s), chr(10)) || '|' || e), 1, 12) as legacy_id
  from paths, (values ('completed'), ('failed'), ('continued-as-new'), ('')) k(e))
"""
)

ORACLES |= {
    "rule_entries": f"with {PART_ENTRIES} select workflow, entry, array_to_string(edges, '|') as edges, array_to_string(options, '|') as options, problem from entry_forms",
    "checked_rules": f"""with {PART_ENTRIES}, r as (select workflow, t || '/' || (ord // 2) as rule_id, max(array_to_string(edges, '|')) filter (ord % 2 = 0) as a, max(array_to_string(edges, '|')) filter (ord % 2 = 1) as b,
        coalesce(string_agg(entry || ': ' || problem, ';' order by entry || ': ' || problem), '') as problems from entry_forms group by all)
      select workflow, rule_id, case when problems = '' then a end as when, case when problems = '' then b end as without, problems from r""",
    "pruned_paths": f"""with {ORDERS}, g as (select distinct workflow, case when had then steps[1:2] else steps[1:3] end as prefix, case when had then 2 else 1 end as grp from paths where not covered and len(steps) > 3)
      select p.workflow, p.path_id, coalesce(min(g.grp), -1) as "group" from paths p left join g on p.workflow = g.workflow and len(p.steps) >= len(g.prefix) and p.steps[1:len(g.prefix)] = g.prefix group by all""",
    "legacy_path_ids": f"with {WORDED} select workflow, path_id, legacy_id from legacy",
    "moved_overrides": f"""with {WORDED}, o as (select workflow, stable_id from worded where had union select workflow, legacy_id from legacy union select workflow, 's1:000000000000' from paths),
      n as (select workflow, stable_id, list_sort(list(distinct path_id)) as own from worded group by all), b as (select workflow, legacy_id as stable_id, list_sort(list(distinct path_id)) as before from legacy group by all)
      select o.workflow, o.stable_id, array_to_string(coalesce(own, before), ' ') as path_ids, case when own is not null then 'own' when len(before) > 1 then 'ambiguous' when before is not null then 'moved' else 'gone' end as found
      from o left join n using (workflow, stable_id) left join b using (workflow, stable_id)""",
    "explained_paths": f"""with {WORDED}, c as (select stable_id, count(distinct workflow) as workflows from worded group by all)
      select stable_id, 'found' as answer, workflows, workflow, path_id, covered, runs from worded join c using (stable_id) where stable_id in (select stable_id from worded where workflow = '1-URGENT')
      union all select 's1:000000000000', 'unknown', 0, null, null, false, 0 union all select 's1:xyz', 'malformed', 0, null, null, false, 0""",
    "floor_parts": f"""with {RULED}
      select '' as workflow, 'path' as basis, count(*) filter (bucket = 'testable' and covered) as covered, count(*) filter (bucket = 'testable') as total from classified where workflow >= '3'
      union all select workflow, 'stage', count(*) filter (covered), count(*) filter (bucket <> 'cannot-be-tested') from classified where workflow < '3' and len(steps) <= 5 group by workflow
      union all select workflow, 'branch', count(*) filter (covered), count(*) from classified where workflow < '3' group by workflow""",
}

STAGED = (
    RULED
    + """,
cut as (select *, list_position(steps, 'N') as p from classified where (covered or bucket <> 'cannot-be-tested') and len(steps) > 0),
ways as (
  select workflow, 0 as stage, case when coalesce(p, 0) = 0 then steps else steps[1:p - 1] end as piece, covered from cut where coalesce(p, 0) <> 1
  union all select workflow, 1, steps[p:], covered from cut where p > 0),
pieces as (select workflow, stage, piece, bool_or(covered) as covered from ways group by all),
staged as (select workflow, stage, count(*) as pieces, count(*) filter (covered) as covered, count(*) > 100 as big from pieces group by all)
"""
)

ORACLES |= {
    "stage_ways": f"with {STAGED} select * from staged",
    "capped_headline": f"""with {STAGED}, e as (select workflow, edge, bool_or(covered) as took from (select workflow, covered, unnest(steps) as edge from paths) group by all)
      select 'path' as kind, count(*) filter (covered)::bigint as covered, count(*)::bigint as total from paths where workflow >= '3'
      union all select 'stage', coalesce(sum(covered), 0)::bigint, coalesce(sum(pieces), 0)::bigint from staged where workflow < '3' and not big
      union all select 'branch', count(*) filter (took), count(*) from e""",
    "handler_totals": f"""with h as ({ORACLES["handler_table"]}), t as (select bool_or(event_type = 'view') as v from events where value > 30),
      o as (select sum(case when exercised <> 'not recorded' then 1 + branches else 0 end) as total, sum(case when exercised <> 'not recorded' then branches_taken + (exercised = 'yes')::int else 0 end) as covered,
        count(*) filter (exercised = 'not recorded') as not_recorded from h where not (handler = 'view' and kind = 'signal'))
      select 'app' as workflow, (covered + coalesce(v, false)::int)::bigint as covered, (total + 2)::bigint as total, not_recorded from o, t""",
    "helper_regions": """select p_brand as workflow, p_type as helper, count(distinct p_size) as decisions, count(distinct p_partkey % 5) as sites, count(distinct p_size) * count(distinct p_partkey % 5) as score
      from part where p_size % 4 > 0 and p_type is not null group by all""",
    "same_list_loops": f"with {ORDERS} select workflow, path_id, 'same-list-loops' as source, 8::int as rank, 'cannot-be-tested' as bucket, 'same-list-loops' as label from paths where list_contains(steps, 'R') and list_contains(steps, 'N')",
    "name_suggestions": """with w as (select distinct replace(p_type, ' ', '.') as workflow, split(p_type, ' ') as parts from part),
      f as (select distinct array_to_string(parts[i:], '.') as hint from w, unnest(range(1, len(parts) + 1)) t(i)),
      n as (select substr(workflow, 2) as name from w union select workflow from w union select repeat(workflow, 3) from w union select substr(parts[-1], 2) from w union select parts[-1] from w union select 'x' || substr(parts[-1], 3, 2) from w),
      d as (select name, hint, levenshtein(lower(name), lower(hint)) as d from n, f where name not in (select hint from f))
      select name, hint from d where d <= least(3, greatest(1, length(name) // 3)) qualify row_number() over (partition by name order by d, hint) = 1""",
    "targets_met": f"with n as ({ORACLES['main_numbers']}) select count(*) filter (met) as met, count(*) filter (workflow <> '5-LOW') as total, count(*) filter (workflow = '5-LOW') as not_measured from n",
    "unread_places": f"""with {ORDER_MAPS} select l_orderkey::varchar as workflow, 'unknown call' as what, 'line ' || l_linenumber as "where" from lineitem where l_quantity > 49
      union all select workflow, 'path cap', 'more than 3 paths' from ends group by workflow having count(*) > 3""",
    "junit_cases": f"""with n as ({ORACLES['main_numbers']}) select workflow, '<testcase name="' || workflow || '">' || case when workflow = '5-LOW' then '<skipped/>'
      when not met then '<failure message="' || kind || ' coverage ' || printf('%.1f', percent) || '%, target 80%"/>' else '' end || '</testcase>' as value from n""",
    "cobertura_lines": """with r as (select l_returnflag as file, l_linenumber::int as line, count(*) as n, count(*) filter (l_quantity > 25) as t from lineitem group by all)
      select file, line, '<line number="' || line || '" hits="' || t || '" branch="true" condition-coverage="' || (t * 100 // n) || '% (' || t || '/' || n || ')"/>' as value from r""",
    "map_charts": f"""with {ORDER_MAPS}, e as (
        select workflow, '  Start -->|| J1' as edge from walked
        union all select workflow, '  J' || i || ' -->|next| ' || case when i = len(flags) then 'End_completed' else 'J' || (i + 1) end from walked, unnest(range(1, len(flags) + 1)) t(i)
        union all select workflow, '  J' || i || ' -->|back| ' || case when flags[i] = 'R' then 'End_failed' else '' end from walked, unnest(range(1, len(flags) + 1)) t(i))
      select workflow, 'flowchart TD' || chr(10) || string_agg(edge, chr(10) order by edge) as value from e group by workflow""",
}

ORACLES |= {
    "map_path_counts": f"with recursive {STAGES} select workflow, c::varchar as paths from counted where number = 0 and stop = (select max(n) + 1 from o where o.workflow = counted.workflow)",
    "map_reachable": f"with {CUSTOMERS} select workflow, 'J' || i || x as edge_id from o, unnest(['.first', '.second']) t(x)",
    "map_stages": f"""with recursive {STAGES} select workflow, stage, 'J' || first_i as entry, case when next_i <= n then 'J' || next_i end as next, ways::varchar as paths, big from staged""",
    "stage_runs": f"with recursive {STAGE_RUNS} select * from hits",
    "stage_totals": f"""with recursive {STAGE_RUNS}, capped as (select workflow from counted join (select workflow, max(n) + 1 as stop from o group by all) using (workflow, stop) where number = 0 and c > 2000)
      select workflow, stage, ways::varchar as paths, big, case when not big then (select count(*) from hits h where h.workflow = staged.workflow and h.stage = staged.stage) end as covered,
        case when not big then ways::bigint end as testable from staged join capped using (workflow)""",
    "pruned_paths": """with recursive f as (
        select l_orderkey::varchar as workflow, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as n, l_returnflag as flag from lineitem),
      walk(workflow, i, n, steps, known, what) as (
        select workflow, 0, n, '', '', 'listed' from f where i = 1
        union all
        select w.workflow, f.i, f.n, trim(steps || ' J' || f.i || '.' || a), known || '[' || flag || ':' || a || ']',
          case when contains(known, '[' || flag || ':' || case a when 'yes' then 'no' else 'yes' end || ']') then flag else 'listed' end
        from walk w join f on f.workflow = w.workflow and f.i = w.i + 1, unnest(['yes', 'no']) t(a) where what = 'listed')
      select workflow, steps, what, case when what = 'listed' then '1' else (1::bigint << (n - i))::varchar end as paths from walk where what <> 'listed' or i = n""",
}

ORACLES |= {
    "entry_check": f"""with {RULED},
      entry as (
        select w.workflow, 'rule' as kind, r.id, r.label, true as claims from (select distinct workflow from paths) w, (values ('many-returns', 'rule'), ('no-return', 'unexplained'), ('known', 'known-defect')) r(id, label)
        union all select workflow, 'override', path_id, case path_id[1] when '0' then 'known-defect' else '' end, path_id[1] = '0' from paths where path_id[1] in ('0', '1')
        union all select '5-LOW', 'override', 'gone', 'known-defect', true union all select '1-URGENT', 'comment', 'R', 'manual', true),
      hit as (
        select workflow, 'rule' as kind, source[6:] as id, path_id from hits
        union all select workflow, 'override', path_id, path_id from paths where path_id[1] in ('0', '1')
        union all select workflow, 'comment', 'R', path_id from paths where workflow = '1-URGENT' and list_contains(steps, 'R')),
      counts as (select workflow, kind, id, count(*) as hits, count(*) filter (covered) as covered from hit join paths using (workflow, path_id) group by all),
      laps as (select a.workflow, a.kind, a.id, array_to_string(list_sort(list(distinct b.kind || ' ' || b.id)), ',') as others from hit a join hit b on a.workflow = b.workflow and a.path_id = b.path_id and (a.kind <> b.kind or a.id <> b.id) group by all)
      select workflow, kind, id, label, coalesce(hits, 0) as hits, coalesce(covered, 0) as covered, case when claims then coalesce(covered, 0) else 0 end as refused, hits is null as stale, sha256(coalesce(others, '')) as overlaps_sha256
      from entry left join counts using (workflow, kind, id) left join laps using (workflow, kind, id)""",
    "outcome_paths": f"""with {ORDERS}, cut as (select *, case when list_contains(steps, 'N') then steps[list_position(steps, 'N') + 1:] else [] end as later from paths),
      more as (select *, case when list_contains(later, 'R') then later[list_position(later, 'R') + 1:] else [] end as after_failure from cut),
      p as (select workflow, path_id, steps, covered and runs > 40 as ran, case when list_contains(after_failure, 'N') or list_contains(after_failure, 'R') then 2 when list_contains(steps, 'R') then 3 when list_contains(steps, 'A') then 5 else 7 end as risk from more),
      x as (select workflow, path_id, ran, risk, i || steps[i] as edge from p, unnest(range(1, len(steps) + 1)) t(i)),
      took as (select distinct workflow, edge from x where ran),
      fresh as (select workflow, path_id, any_value(risk) as risk, count(*) filter ((workflow, edge) not in (select (workflow, edge) from took)) as new_exits from x where not ran group by all),
      best as (select x.workflow, x.edge, f.path_id, f.risk, f.new_exits from x join fresh f using (workflow, path_id) where not ran and (x.workflow, x.edge) not in (select (workflow, edge) from took)
        qualify row_number() over (partition by x.workflow, x.edge order by f.risk desc, f.new_exits, f.path_id) = 1)
      select workflow, edge as branch_id, ['cancel', 'compensation', 'activity failure', 'continue-as-new', 'timers and timeouts', 'signals and updates', 'plain logic'][risk] as risk, path_id as number, new_exits from best""",
    "rule_drafts": f"""with {_settled()}, review as (select * from settled where not covered and bucket = 'needs-review' and label <> 'known-defect'),
      g as (select workflow, label, count(*) as n, min_by(steps, path_id) as first_steps from review group by all),
      e as (select workflow, label, s from (select distinct workflow, label, path_id, unnest(steps) as s from review) join g using (workflow, label) group by workflow, label, s having count(*) = any_value(n)),
      shared as (select workflow, label, list(s) as shared from e group by all),
      w as (select g.*, list_filter(first_steps, lambda x: list_contains(coalesce(shared, []), x)) as needs from g left join shared using (workflow, label)),
      o as (select *, len(needs) > 0 and not exists (select 1 from settled s where s.workflow = w.workflow and list_has_all(s.steps, needs) and not (not s.covered and s.bucket = 'needs-review' and s.label = w.label)) as one from w),
      d as (select workflow, label, min(path_id) as number, any_value(needs) as needs, list(path_id order by path_id) as ids, false as exact from review join o using (workflow, label) where one group by workflow, label
        union all select workflow, label, path_id, steps, [path_id], true from review join o using (workflow, label) where not one)
      select workflow, label, regexp_replace('review-' || workflow || '-' || label, '[^A-Za-z0-9_-]+', '-', 'g') || '-' || row_number() over (order by workflow, label, number) as rule_id, array_to_string(needs, ' ') as "when", sha256(array_to_string(ids, ',')) as paths_sha256, len(ids) as paths, exact from d""",
}


def _external() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    said = [f"({text(w)}, {text(e)}, {k}, {text(x)})" for w, of in pilot.STEPS.items() for e, steps in of.items() for k, x in enumerate(steps)]
    zero = [f"({text(w)}, {text(e)}, {text(step)}, {text(iterate)})" for w, of in pilot.ZERO_ROUNDS.items() for e, (step, iterate) in of.items()]
    return f"said(workflow, edge, k, step) as (values {', '.join(said)}), zero(workflow, edge, step, iterate) as (values {', '.join(zero)})"


ORDER_WORDS = f"""{ORDER_MAPS},
spoken as (
  select distinct e.workflow, list_transform(list_filter(flags[1:case "end" when 'failed' then pos - 1 else len(flags) end], lambda f: f = 'N'), lambda f: 'shipped')
    || case "end" when 'failed' then ['returned', 'end: failed'] else ['end: completed'] end as steps
  from ends e join walked using (workflow))"""

ORACLES |= {
    "pilot_scenarios": f"""with recursive {MAP}, {_external()},
      step_of as (select workflow, number, steps, i from listed, unnest(range(1, len(steps) + 1)) t(i)),
      say as (
        select a.workflow, number, i, k, step from step_of a join said s on s.workflow = a.workflow and s.edge = steps[i]
        union all select a.workflow, number, i, 99, step from step_of a join zero z on z.workflow = a.workflow and z.edge = steps[i] where not list_contains(steps[1:i - 1], iterate)),
      w as (select l.workflow, l.number, any_value(l.end_kind) || '|' || coalesce(string_agg(step, chr(31) order by i, k), '') as word from listed l left join say using (workflow, number) group by l.workflow, l.number)
      select workflow, count(distinct word)::varchar as scenarios from w group by workflow""",
    "map_scenarios": f"with {ORDER_WORDS} select workflow, count(*)::varchar as scenarios from spoken group by workflow",
    "map_scenario_words": f"with {ORDER_WORDS} select workflow, row_number() over (partition by workflow order by steps)::int as number, array_to_string(steps, ' ') as steps, false as truncated from spoken",
}

OUTCOMES = RULED + """,
x as (select workflow, i || steps[i] as branch_id, covered, bucket, runs from classified, unnest(range(1, len(steps) + 1)) t(i)),
added as (
  select workflow, branch_id, case when bool_or(covered) then 'covered' when bool_and(bucket = 'cannot-be-tested') then 'impossible' else 'missed' end as status
  from x group by workflow, branch_id having max(runs) <= 2)"""

ORACLES |= {
    "main_drops": f"""with {ORDERS}, c as (select workflow, 100.0::double * count(*) filter (covered) / count(*) as percent, 100.0::double * count(*) filter (had) / count(*) as was from paths where workflow <> '1-URGENT' group by workflow),
      f as (select workflow, case when workflow = '5-LOW' then 'not measured' when workflow = '4-NOT SPECIFIED' then 'kind changed' when percent < was - 0.5 then 'drop' end as finding, was, case when workflow <> '5-LOW' then percent end as percent from c)
      select * from f where finding is not null""",
    "new_outcomes": f"with {OUTCOMES} select * from added where status <> 'impossible'",
    "new_coverage": f"with {OUTCOMES}, n as (select count(*) filter (status = 'covered') as covered, count(*) as total from added where status <> 'impossible') select covered, total, covered * 100.0::double / total as percent from n where total > 0",
    "tested_changes": f"with {ORDERS} select workflow, path_id, 'new' as change, covered as tested from paths where not had",
}

AROUND = """
l as (select l_orderkey::varchar as workflow, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as n, l_returnflag = 'R' as fails from lineitem),
-- ways from line a on that have ended or are about to enter line b + 1
span(workflow, n, a, b, live, ended) as (
  select workflow, n, i, i, case when fails then 1 else 2 end, case when fails then 1 else 0 end from l
  union all
  select s.workflow, s.n, a, b + 1, live * case when fails then 1 else 2 end, ended + case when fails then live else 0 end from span s join l on l.workflow = s.workflow and l.i = b + 1),
m as (select workflow, n, a, b, live + ended as c, live, ended from span),
whole as (select workflow, n, c + 1 as c, (live + 1) * 2 + ended as merged from m where a = 1 and b = n),
cut(workflow, a, b) as (
  select m.workflow, 1, max(b) from m join whole using (workflow) where whole.c > 8 and m.a = 1 and (m.c <= 8 or m.b = 1) group by m.workflow
  union all
  select c.workflow, c.b + 1, (select max(m.b) from m where m.workflow = c.workflow and m.a = c.b + 1 and (m.c <= 8 or m.b = m.a)) from cut c join whole using (workflow) where c.b < whole.n),
rows_ as (
  select workflow, 0 as k, 0 as of_stage, 'J1' as entry, merged as paths, null as split_from from whole where merged <= 8
  union all select workflow, 0, 0, 'J1', case when c > 8 then 2 else c end, case when c > 8 then c end from whole where merged > 8
  union all select cut.workflow, cut.a, 0, 'J' || (cut.a + 1), m.c, whole.c from cut join m using (workflow, a, b) join whole using (workflow)
  union all select workflow, 1000, 1, 'J' || (n + 2), 2, null from whole where merged > 8)"""

ORACLES |= {
    "stage_parts": f"""with recursive {AROUND}
      select workflow, row_number() over (partition by workflow order by k) - 1 as stage, of_stage::bigint as of_stage, entry, paths::varchar as paths, false as big, split_from is not null as is_part, split_from::varchar as split_from, null::varchar as why from rows_""",
    "converted_runs": """with l as (
        select o_orderpriority as workflow, l_orderkey as order_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as n,
          l_returnflag as flag, l_linenumber as line, 'K' || (l_suppkey % 4) as k from lineitem join orders on l_orderkey = o_orderkey),
      r as (select order_id, order_id % 5 <> 0 and not bool_or((flag = 'N' and line = 7) or (flag = 'R' and k = 'K3')) as converted, order_id % 7 = 0 and max_by(flag, i) <> 'N' as bad_markers from l group by order_id),
      w as (select order_id, converted, bad_markers, i,
          case when flag = 'N' then (case when converted then 'D' else 'J' end) || line else (case when converted then 'H' else 'S' end) || flag || '.' || k end as step, flag,
          case when flag = 'N' then '' when converted then 'H' || flag else 'S' || flag end as place, i = n and bad_markers as lost from l join r using (order_id))
      select order_id, converted, bad_markers,
        case when bad_markers then string_agg(case when flag = 'N' then step else '>' || place || ' ' || step || case when lost then '' else ' <' || place end end, ' ' order by i)
          else coalesce(string_agg(step, ' ' order by i) filter (flag = 'N' or not converted), '') end as steps,
        case when bad_markers then '' else coalesce(string_agg(step, ' ' order by i) filter (flag <> 'N' and converted), '') end as unit_hits
      from w group by order_id, converted, bad_markers""",
    "loop_spans": """with l as (select l_orderkey as order_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, l_returnflag as flag, (l_suppkey % 2)::varchar as loop from lineitem),
      s as (select *, coalesce(sum(case when flag = 'N' then 1 when flag = 'R' and loop = '0' then 2 when flag = 'R' then 1 when loop = '0' then 1 else 0 end) over (partition by order_id order by i rows between unbounded preceding and 1 preceding), 0) as before,
        sum(case when flag = 'N' then 1 when flag = 'R' and loop = '0' then 2 when flag = 'R' then 1 when loop = '0' then 1 else 0 end) over (partition by order_id) as total from l),
      e as (select *, lead(flag) over (partition by order_id, loop order by i) as next_flag, lead(before) over (partition by order_id, loop order by i) as next_before from s where flag <> 'N')
      select order_id, (row_number() over (partition by order_id order by i) - 1)::int as number, loop, (before + 1)::int as from_step, (case when next_flag = 'A' then next_before else total end)::int as to_step from e where flag = 'R'""",
    "named_workflows": """with p as (select replace(p_name, ' ', '.') as own, p_brand as brand, p_type as type, case when p_size % 2 = 0 then 'f' || (p_size % 3) || '/' else '' end || p_brand || '.' || replace(p_name, ' ', '.') as workflow from part),
      w as (select distinct workflow, regexp_replace(workflow, '^.*/', '') as plain from p),
      asked as (select own as name from p union select brand || '.' || own from p union select '(*' || type || ')' from p union select workflow from p),
      a as (select name, replace(replace(name, '(*', ''), ')', '') as want from asked),
      m as (select name, list(distinct workflow order by workflow) filter (workflow is not null) as found from a left join w on workflow = want or ends_with(workflow, '.' || want) or (not contains(want, '/') and (plain = want or ends_with(plain, '.' || want))) group by name)
      select name, case when len(found) = 1 then found[1] end as workflow, coalesce(array_to_string(found, ' '), '') as matches, case when found is null then 'none' when len(found) > 1 then 'several' end as problem from m""",
}
