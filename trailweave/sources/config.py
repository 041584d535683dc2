"""Configuration files: strict JSON, checked on the driver, as small tables that the operators join.

A file is bounded by what people write. Unknown keys are refused with the nearest known one; every exclusion,
override, rule and explained run needs its reason.
"""

from __future__ import annotations

import difflib
import json

from pyspark.sql import DataFrame, SparkSession

#: Keys of each part of a file (fixed values).
KEYS = {
    "": ("packages", "traces", "workflows", "failUnder", "html", "out", "json", "noColor", "allowStale", "classification", "branches"),
    "workflows": ("include", "exclude"),
    "workflows.exclude": ("name", "reason"),
    "classification": (
        "enabled", "paths", "rules", "custom_labels", "unclassified_policy", "detectors", "explained_traces", "ci", "engine",
        "stages", "assumptions", "helpers", "activity_wrappers", "direct_returns", "loops", "scenarios", "targets", "main_number",
    ),
    "classification.paths": ("mark_untestable", "mark_testable"),
    "classification.paths.mark_untestable": ("workflow", "stable_id", "label", "reason", "added_by", "added_on"),
    "classification.paths.mark_testable": ("workflow", "stable_id", "reason"),
    "classification.rules": ("id", "workflow", "label", "when", "without", "impossible", "reason"),
    "classification.custom_labels": ("name", "definition", "bucket"),
    "classification.detectors": ("disable",),
    "classification.detectors.disable": ("name", "reason"),
    "classification.explained_traces": ("workflow", "steps_id", "reason"),
    "classification.ci": (
        "baseline", "fail_under_testable", "stage_floor", "capped_basis", "tolerance", "main_floor", "branch_floor",
    ),
    "classification.main_number": ("force",),
    "classification.main_number.force": ("workflow", "kind", "reason"),
}
#: What an entry of a list has to hold as a text that is not blank.
NEEDED = {
    "workflows.exclude": ("name", "reason"),
    "classification.paths.mark_untestable": ("workflow", "stable_id", "label", "reason"),
    "classification.paths.mark_testable": ("workflow", "stable_id", "reason"),
    "classification.rules": ("id", "workflow", "label", "reason"),
    "classification.custom_labels": ("name", "definition", "bucket"),
    "classification.detectors.disable": ("name", "reason"),
    "classification.explained_traces": ("workflow", "steps_id", "reason"),
    "classification.main_number.force": ("workflow", "kind", "reason"),
}
#: Values of settings that are a choice; the first is the default (fixed values).
CHOICES = {"unclassified_policy": ("count_as_testable", "exclude"), "capped_basis": ("stage", "branch")}
PERCENTS = ("fail_under_testable", "stage_floor", "main_floor", "branch_floor")


class ConfigError(ValueError):
    """A configuration that can't be used, and why."""


def _refused(pairs: list[tuple[str, object]]) -> dict:
    seen = dict(pairs)
    if len(seen) < len(pairs):
        raise ConfigError(f"a key is given twice among {sorted(seen)}")
    return seen


def _checked(part: object, place: str, entry_of_list: bool = False) -> None:
    """Walks the parts whose keys are known; the other parts are taken as they are."""
    if place in NEEDED and not entry_of_list:
        if not isinstance(part, list):
            raise ConfigError(f"{place} must be a list")
        for i, entry in enumerate(part):
            if not isinstance(entry, dict):
                raise ConfigError(f"{place}[{i}] must be an object with {', '.join(NEEDED[place])}")
            _checked(entry, place, True)
            for key in NEEDED[place]:
                if not isinstance(entry.get(key), str) or not entry[key].strip():
                    raise ConfigError(f'{place}[{i}] needs a "{key}"')
        return
    if place not in KEYS:
        return
    if not isinstance(part, dict):
        raise ConfigError(f"{place or 'the file'} must be an object")
    for key, value in part.items():
        if key not in KEYS[place]:
            near = difflib.get_close_matches(key, KEYS[place], 1)
            raise ConfigError(f'unknown key "{key}"{" in " + place if place else ""}' + (f'; did you mean "{near[0]}"?' if near else ""))
        if value is not None:
            _checked(value, f"{place}.{key}" if place else key)


def parsed(data: bytes) -> dict:
    """The settings of a file. A UTF-8 byte order mark is skipped; UTF-16, unknown or repeated keys and bad values are errors."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ConfigError("the file is saved as UTF-16; save it as UTF-8")
    try:
        out = json.loads(data.decode("utf-8-sig"), object_pairs_hook=_refused)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ConfigError(f"not JSON: {e}") from e
    _checked(out, "")
    include = (out.get("workflows") or {}).get("include")
    if include is not None and (not isinstance(include, list) or not include or not all(isinstance(n, str) and n.strip() for n in include)):
        raise ConfigError("workflows.include must name workflows, or be left out to include all")
    section = out.get("classification") or {}
    ci = section.get("ci") or {}
    for holder, where in ((section, "classification"), (ci, "classification.ci")):
        for key, allowed in CHOICES.items():
            if holder.get(key) is not None and holder[key] not in allowed:
                raise ConfigError(f"{where}.{key} must be {' or '.join(allowed)}")
    for key, value in [("failUnder", out.get("failUnder")), *((k, ci.get(k)) for k in PERCENTS)]:
        if value is not None and (isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 100):
            raise ConfigError(f"{key} must be a number from 0 to 100")
    ids = [r["id"] for r in section.get("rules") or []]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ConfigError(f"rules share an id: {', '.join(twice)}")
    return out


def read_config(path: str) -> dict:
    """parsed, of a file on the driver's machine; the error names the file."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        return parsed(data)
    except ConfigError as e:
        raise ConfigError(f"{path}: {e}") from e


def tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """include (None if all are), exclude, overrides, entries (of rules, for entries.resolved), explained, force, and off, the detectors that are off."""
    section = config.get("classification") or {}
    scope = config.get("workflows") or {}
    paths = section.get("paths") or {}
    rows = lambda entries, *names: [tuple(e.get(n) for n in names) for e in entries or []]
    make = spark.createDataFrame
    untestable = [(*r, "cannot-be-tested") for r in rows(paths.get("mark_untestable"), "workflow", "stable_id", "label", "reason")]
    testable = [(w, i, "testable", why, "testable") for w, i, why in rows(paths.get("mark_testable"), "workflow", "stable_id", "reason")]
    said = [
        (r["workflow"], r["id"], r["label"], r["reason"], part, n, text)
        for r in section.get("rules") or [] for part in ("when", "without") for n, text in enumerate(r.get(part) or [])
    ]
    return {
        "include": make([(n,) for n in scope["include"]], "name string") if scope.get("include") else None,
        "exclude": make(rows(scope.get("exclude"), "name", "reason"), "name string, reason string"),
        "overrides": make(untestable + testable, "workflow string, stable_id string, label string, reason string, bucket string"),
        "entries": make(said, "workflow string, rule_id string, label string, reason string, part string, ord int, entry string"),
        "explained": make(rows(section.get("explained_traces"), "workflow", "steps_id", "reason"), "workflow string, steps_id string, reason string"),
        "force": make(rows((section.get("main_number") or {}).get("force"), "workflow", "kind", "reason"), "workflow string, kind string, reason string"),
        "off": make(rows((section.get("detectors") or {}).get("disable"), "name", "reason"), "name string, reason string"),
    }
