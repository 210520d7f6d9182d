"""Forms' templates and models' cards: read, checked, and made into tables.

A template is a dictionary (from JSON or TOML, or what another reader gives): name, family, concurrent, valid_from, valid_to,
handler, options, regions (name, role, header_rows, ys, xs, columns, rows) and fields (name, kind, meta_key, format, bbox).
"""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.formats import FORMATS

KINDS = ("printed", "handwritten_text", "handwritten_number", "checkmark", "signature")
ROLES = (None, "meter", "shifts", "tally", "activities")
#: Format by kind of cell where a template names none.
DEFAULT_FORMAT = {"handwritten_number": "integer"}
_TABLES = {
    "template": "template string, family string, concurrent boolean, valid_from string, valid_to string, handler string",
    "region": "template string, region string, region_no int, role string, header_rows int, ys array<int>, xs array<int>",
    "column": "template string, region string, idx int, name string, kind string, format string, meta map<string,string>",
    "row": "template string, region string, row int, key string, meta map<string,string>",
    "field": "template string, name string, kind string, meta_key string, format string, bbox array<int>",
}


def read_template(path: str) -> dict:
    text = Path(path).read_text("utf-8")
    return tomllib.loads(text) if path.endswith(".toml") else json.loads(text)


def problems(t: dict) -> list[str]:
    """What is wrong with a template by itself."""
    out = []
    if not t.get("name"):
        out.append("a template needs a name")
    for day in ("valid_from", "valid_to"):
        if t.get(day) is not None and (len(str(t[day])) != 10 or str(t[day])[4] != "-"):
            out.append(f"{day} isn't a day")
    if t.get("valid_from") and t.get("valid_to") and str(t["valid_from"]) > str(t["valid_to"]):
        out.append("valid_from is after valid_to")
    regions = t.get("regions", [])
    out += [f"region {n} occurs {k} times" for n, k in Counter(r.get("name") for r in regions).items() if k > 1 or not n]
    for r in regions:
        at = f"region {r.get('name')}: "
        columns, rows = r.get("columns", []), r.get("rows", [])
        if r.get("role") not in ROLES:
            out.append(f"{at}no role {r['role']!r}")
        if len(r.get("xs", [])) < max((c["idx"] for c in columns), default=-1) + 2:
            out.append(f"{at}fewer grid lines than columns")
        if len(r.get("ys", [])) < max((x["row"] for x in rows), default=-1) + r.get("header_rows", 0) + 2:
            out.append(f"{at}fewer grid lines than rows")
        out += [f"{at}column {n} occurs {k} times" for n, k in Counter(c["name"] for c in columns).items() if k > 1]
        out += [f"{at}row {n} occurs {k} times" for n, k in Counter(x["row"] for x in rows).items() if k > 1]
        out += [f"{at}{c['name']}: no kind {c.get('kind')!r}" for c in columns if c.get("kind") not in KINDS]
        out += [f"{at}{c['name']}: no format {c['format']!r}" for c in columns if c.get("format") not in (None, *FORMATS)]
        if r.get("role") == "meter":
            slots = Counter(s for s in ([c["name"] for c in columns if c["name"] in ("start", "end", "total")] or [x.get("key") for x in rows]) if s in ("start", "end", "total"))
            out += [f"{at}a meter needs one {s}" for s in ("start", "end") if slots[s] != 1]
        if r.get("role") == "shifts" and not any(c.get("format") == "time_range" for c in columns):
            out.append(f"{at}shifts need a column of time ranges")
    out += [f"field {n} occurs {k} times" for n, k in Counter(f["name"] for f in t.get("fields", [])).items() if k > 1]
    out += [f"field {f['name']}: no kind {f.get('kind')!r}" for f in t.get("fields", []) if f.get("kind") not in KINDS]
    # haul rows: one line for each material and level
    hauls = Counter((x.get("material"), x.get("level"), x.get("shift")) for r in regions for x in r.get("rows", []) if "material" in x)
    out += [f"material {m}, level {v} occurs {k} times" for (m, v, _), k in hauls.items() if k > 1]
    return out


def family_problems(templates: list[dict]) -> list[str]:
    """What is wrong between templates: names, validity, and concurrent ones that don't have the same cells."""
    out = [f"template {n} occurs {k} times" for n, k in Counter(t["name"] for t in templates).items() if k > 1]
    by: dict[str, list[dict]] = {}
    for t in templates:
        by.setdefault(t.get("family") or t["name"], []).append(t)
    for family, members in sorted(by.items()):
        for i, a in enumerate(members):
            for b in members[:i]:
                together = max(str(a.get("valid_from") or ""), str(b.get("valid_from") or "")) <= min(str(a.get("valid_to") or "9999"), str(b.get("valid_to") or "9999"))
                if a.get("concurrent") and b.get("concurrent"):
                    differ = cell_keys(a) ^ cell_keys(b)
                    out += [f"family {family}: {a['name']} and {b['name']} differ in {sorted(differ)[:3]}"] if differ else []
                elif together:
                    out.append(f"family {family}: {b['name']} and {a['name']} are valid on a common day")
    return out


def cell_keys(t: dict) -> set[tuple[str, str, str]]:
    """What a template's cells are known by: region, column, row key."""
    cells = {(r["name"], c["name"], str(x.get("key", ""))) for r in t.get("regions", []) for c in r.get("columns", []) for x in r.get("rows", [])}
    return cells | {("fields", f["name"], "") for f in t.get("fields", [])}


def tables(spark: SparkSession, templates: list[dict]) -> dict[str, DataFrame]:
    """The catalog's tables (see _TABLES); a faulty template is an error that names all its faults."""
    wrong = {t.get("name"): p for t in templates if (p := problems(t))}
    if wrong or (between := family_problems(templates)):
        raise ValueError(f"faulty templates: {wrong or between}")
    text = lambda d, *without: {k: str(v) for k, v in d.items() if k not in without and v is not None}
    rows: dict[str, list[tuple]] = {k: [] for k in _TABLES}
    for t in templates:
        n = t["name"]
        rows["template"].append((n, t.get("family") or n, bool(t.get("concurrent")), t.get("valid_from"), t.get("valid_to"), t.get("handler", "generic")))
        for i, r in enumerate(t.get("regions", [])):
            rows["region"].append((n, r["name"], i, r.get("role"), r.get("header_rows", 0), list(r["ys"]), list(r["xs"])))
            rows["column"] += [(n, r["name"], c["idx"], c["name"], c["kind"], c.get("format") or DEFAULT_FORMAT.get(c["kind"]), text(c, "idx", "name", "kind", "format")) for c in r.get("columns", [])]
            rows["row"] += [(n, r["name"], x["row"], str(x.get("key", "")), text(x, "row", "key")) for x in r.get("rows", [])]
        rows["field"] += [(n, f["name"], f["kind"], f.get("meta_key"), f.get("format") or DEFAULT_FORMAT.get(f["kind"]), list(f.get("bbox", []))) for f in t.get("fields", [])]
    return {k: spark.createDataFrame(rows[k], schema) for k, schema in _TABLES.items()}


def route_problems(by_format: dict[str, str], by_kind: dict[str, str], declared: dict[str, dict]) -> list[str]:
    """Routes to recognisers (format or kind: name) that name unknown ones, or ones that don't read what is sent to them.
    ``declared``: name: {"formats": [...], "kinds": [...]}."""
    out = []
    for what, routes, known in (("formats", by_format, FORMATS), ("kinds", by_kind, KINDS)):
        for k, name in sorted(routes.items()):
            if k not in known:
                out.append(f"no such entry of {what}: {k}")
            elif name not in declared:
                out.append(f"no recogniser {name}")
            elif k not in declared[name].get(what, []):
                out.append(f"{name} doesn't read {k}")
    return out


# --- models ----------------------------------------------------------------------------------------------------------


def model_problems(folder: str) -> list[str]:
    """What is wrong with a model's folder: its card must name what it reads, its thresholds, and the file's hash."""
    at = Path(folder)
    try:
        card = json.loads((at / "card.json").read_text("utf-8"))
    except (OSError, ValueError) as e:
        return [f"no card: {type(e).__name__}"]
    out = [f"the card has no {k}" for k in ("name", "reads", "threshold", "sha256") if k not in card]
    if not (isinstance(card.get("threshold"), (int, float)) and 0 <= card["threshold"] <= 1):
        out.append("the threshold isn't between 0 and 1")
    if not (isinstance(card.get("temperature", 1.0), (int, float)) and card.get("temperature", 1.0) > 0):
        out.append("the temperature isn't positive")
    file = at / card.get("file", "model.onnx")
    if not file.is_file():
        out.append(f"no file {file.name}")
    elif hashlib.sha256(file.read_bytes()).hexdigest() != card.get("sha256"):
        out.append("the file isn't the card's")
    return out


def models(root: str) -> dict[str, list[str]]:
    """The models below a folder with what is wrong with each; folders being written (".staging") don't count."""
    at = Path(root)
    return {p.name: model_problems(str(p)) for p in sorted(at.iterdir()) if p.is_dir() and not p.name.endswith(".staging")} if at.is_dir() else {}


def clear_staging(root: str) -> list[str]:
    """Take away what interrupted writes of models left."""
    gone = []
    for p in sorted(Path(root).glob("*.staging")):
        for x in sorted(p.rglob("*"), reverse=True):
            x.rmdir() if x.is_dir() else x.unlink()
        p.rmdir()
        gone.append(p.name)
    return gone
