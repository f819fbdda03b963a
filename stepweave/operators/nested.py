"""Deeply nested records as flat tables with parent-child links.

Method: Merkle identities. Every object of a snapshot, at any depth, is
canonicalised and hashed bottom-up: in a node's content a nested object is
replaced by its hash, so a hash covers all that lies below. Two tables come
out: ``nodes`` holds each distinct object once under its hash, ``bridge`` holds
a row for each place in which one stands (snapshot, kind, parent, key or
position, ordinal), so that the original nesting can be rebuilt from both.
Parts with a known meaning (scene objects, contacts, robots, ...) have a kind
of their own; every other object is an ``object`` under the one around it.

A snapshot is decoded in one pass over Arrow batches, which gives the rows of
both tables. They meet again by (salt, hash): the salt comes from the snapshot
and spreads an object that stands in a great part of all snapshots.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.runtime import stored

BRIDGE = "snapshot_id long, salt int, child_kind string, parent_key string, child_key string, ordinal int, parent_hash string, child_hash string, content string"
BATCH_ROWS = 20_000
#: Parts into which the occurrences of one object are spread; contents a task remembers as sent.
SALTS, SENT = 64, 200_000
MISSING = object()
CONTAINERS = frozenset((dict, list))
_number = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_blank = re.compile(r"[ \t\n\r]*")
_dumps = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
# The names that JSON texts hold besides strings and numbers.
NAMES = {"null": None, "true": True, "false": False, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def node_hash(kind: str, content: str, children: list[tuple[str, str, str]]) -> str:
    """128 bits as hex. children: (kind, key, hash) in order."""
    h = hashlib.blake2b(f"{kind}\n{content}".encode("utf-8", "surrogatepass"), digest_size=16)
    for part in children:
        h.update("\0".join(("", *part)).encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def parse_deep(text: str) -> Any:
    """The value of a JSON text of any depth, without recursion; ValueError if it isn't complete JSON."""
    top: list = []
    stack: list[Any] = [top]
    keys: list[str] = []
    at, want = _blank.match(text).end(), "value"  # value, value or end, key, key or end, comma
    while True:
        c = text[at : at + 1]
        box = stack[-1]
        if want == "comma":
            if box is top:
                break
            if c == ",":
                want = "key" if type(box) is dict else "value"
            elif c == ("}" if type(box) is dict else "]"):
                stack.pop()
            else:
                raise ValueError(at)
            at = _blank.match(text, at + 1).end()
            continue
        if c and c == {"key or end": "}", "value or end": "]"}.get(want):
            stack.pop()
            at, want = _blank.match(text, at + 1).end(), "comma"
            continue
        if want.startswith("key"):
            if c != '"':
                raise ValueError(at)
            key, at = json.decoder.scanstring(text, at + 1)
            at = _blank.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(at)
            keys.append(key)
            at, want = _blank.match(text, at + 1).end(), "value"
            continue
        want = "comma"
        if c == '"':
            v, at = json.decoder.scanstring(text, at + 1)
        elif c and c in "{[":
            v, want, at = ({}, "key or end", at + 1) if c == "{" else ([], "value or end", at + 1)
        elif name := next((n for n in NAMES if text.startswith(n, at)), None):
            v, at = NAMES[name], at + len(name)
        elif m := _number.match(text, at):
            v, at = (float if m[1] or m[2] else int)(m[0]), m.end()
        else:
            raise ValueError(at)
        if type(box) is dict:
            box[keys.pop()] = v
        else:
            box.append(v)
        if want != "comma":
            stack.append(v)
        at = _blank.match(text, at).end()
    if at < len(text):
        raise ValueError(at)
    return top[0]


def read_json(text: Any) -> Any:
    """The value of a JSON text, also if it is wrapped in JSON strings; MISSING if it isn't complete JSON."""
    try:
        while isinstance(text, str):
            try:
                text = json.loads(text)
            except RecursionError:
                text = parse_deep(text)
        return text
    except ValueError:
        return MISSING


def _part(value: Any) -> Any:
    """A part of a document; a JSON string that holds JSON counts as that JSON, any other string as itself."""
    if isinstance(value, str):
        inner = read_json(value)
        return value if inner is MISSING else inner
    return value


def _get(value: Any, key: str) -> Any:
    value = _part(value)
    return _part(value.get(key)) if isinstance(value, dict) else None


def _listed(part: Any) -> list[tuple[int, dict]]:
    """(position, object) of a part that is a list, or a lone object at position 0."""
    if isinstance(part, dict):
        return [(0, part)] if part else []
    if isinstance(part, list):
        return [(i, v) for i, x in enumerate(part) if isinstance(v := _part(x), dict)]
    return []


def _named(part: Any) -> list[tuple[str, dict]]:
    """(name, object) of a part keyed by name, or of a list (or lone object) whose elements have a field ``name``."""
    if isinstance(part, dict):
        if isinstance(part.get("name"), str):  # a lone element: a keyed part holds objects, not texts
            return [(part["name"], part)] if not isinstance(_part(part["name"]), dict) else _keyed(part)
        return _keyed(part)
    if isinstance(part, list):
        return [(str(v["name"]), v) for x in part if isinstance(v := _part(x), dict) and v.get("name") is not None]
    return []


def _keyed(part: dict) -> list[tuple[str, dict]]:
    return [(k, v) for k, x in part.items() if isinstance(v := _part(x), dict)]


def _owners(part: Any) -> list[tuple[int, Any]]:
    part = _part(part)
    if part is None or part == {}:
        return []
    if isinstance(part, list):
        return [(i, x) for i, x in enumerate(part) if x is not None]
    return [(0, part)]


def _rest(state: dict) -> dict:
    """What no child record holds."""
    out = {k: v for k, v in state.items() if k not in ("objects", "fixtures")}
    for part, inner in (("contact_and_grasp", "contacts"), ("goals", "goal_predicates")):
        if isinstance(v := _part(out.get(part)), dict):
            out[part] = {k: x for k, x in v.items() if k != inner}
    return out


def _holds(v: Any) -> bool:
    """Is this an object, or a list that holds lists or objects? An empty object is written in place."""
    return (type(v) is dict and bool(v)) or (type(v) is list and not CONTAINERS.isdisjoint(map(type, v)))


def content_of(value: Any) -> tuple[str, list[tuple]]:
    """Canonical text of a record, and the objects right below it: sorted keys, no blanks, each nested object as its hash.

    An object below is (kind, key, ordinal, hash, content, objects below); its
    key is its path inside the object around it. Works bottom-up without recursion.
    """
    if not _holds(value) or (type(value) is dict and not any(map(_holds, value.values()))):
        return _dumps(value), []
    # a frame: (is it an object, its path, what is still to come, parts so far, objects below, text before its value)
    frames: list[tuple] = []

    def enter(v: Any, path: str, below: list, before: str) -> None:
        if type(v) is dict:
            frames.append((True, path, iter(sorted(v.items())), [], [], before))
        else:
            frames.append((False, path, iter(enumerate(v)), [], below, before))

    enter(value, "", [], "")
    while True:
        is_object, path, rest, parts, below, before = frames[-1]
        for k, v in rest:
            name = _dumps(k) + ":" if is_object else ""
            if _holds(v):
                enter(v, str(k) if is_object else f"{path}.{k}" if path else str(k), below, name)
                break
            parts.append(name + _dumps(v))
        else:
            frames.pop()
            text = ("{%s}" if is_object else "[%s]") % ",".join(parts)
            if not frames:
                return text, below
            if is_object:
                h, up = node_hash("object", text, []), frames[-1][4]
                up.append(("object", path, len(up), h, text, below))
                text = '{"#":"%s"}' % h
            frames[-1][3].append(before + text)


class Decoder:
    """Turns a snapshot into records; children come before parents."""

    def __init__(self, with_content: bool) -> None:
        self.with_content = with_content
        self.rows: list[tuple] = []
        self.sent: set[tuple[int, str]] = set()

    def snapshot(self, snapshot_id: Any, json_state: str | None, robots: list | None, observables: str | None) -> None:
        top: list[tuple] = []
        state = read_json(json_state)
        if isinstance(state, dict):
            for kind, key in (("scene_object", "objects"), ("fixture", "fixtures")):
                for i, (name, v) in enumerate(_named(_get(state, key))):
                    top.append(self.leaf(kind, name, i, v))
            for i, v in _listed(_get(_get(state, "contact_and_grasp"), "contacts")):
                top.append(self.contact(i, v))
            for i, v in _listed(_get(_get(state, "goals"), "goal_predicates")):
                top.append(self.leaf("goal_predicate", str(i), i, v))
        for i, r in enumerate(robots or []):
            if r is not None:
                top.append(self.robot(i, r))
        seen = read_json(observables)
        if isinstance(seen, dict):
            for i, (name, v) in enumerate(_keyed(seen)):
                top.append(self.observable(name, i, v))
        root = self.leaf("snapshot", "", 0, _rest(state) if isinstance(state, dict) else None, top)
        salt = zlib.crc32(str(snapshot_id).encode()) % SALTS
        todo = [("", "", root)]
        while todo:
            parent_hash, parent_key, (kind, key, ordinal, h, content, below) = todo.pop()
            first = self.with_content and (salt, h) not in self.sent
            if first:
                if len(self.sent) >= SENT:
                    self.sent.clear()
                self.sent.add((salt, h))
            self.rows.append((snapshot_id, salt, kind, parent_key, key, ordinal, parent_hash, h, content if first else None))
            todo += [(h, key, b) for b in below]

    def leaf(self, kind: str, key: str, ordinal: int, value: Any, below: list[tuple] | None = None) -> tuple:
        content, nested = content_of(value)
        below = below or []
        return (kind, key, ordinal, node_hash(kind, content, [(b[0], b[1], b[3]) for b in below]), content, below + nested)

    def contact(self, i: int, v: dict) -> tuple:
        below = []
        for side in ("geom1_owners", "geom2_owners"):
            for pos, owner in _owners(v.get(side)):
                below.append(self.leaf("contact_owner", f"{side}.{pos}", pos, owner))
        return self.leaf("contact", str(i), i, {k: x for k, x in v.items() if k not in ("geom1_owners", "geom2_owners")}, below)

    def robot(self, i: int, r: dict) -> tuple:
        below = []
        for n, (k, x) in enumerate(r.get("controller_fields") or []):
            if x is not None:
                below.append(self.leaf("controller_field", k, n, x))
        for n, f in enumerate(r.get("robot_fields") or []):
            if f is not None and f.get("field_name") is not None:
                below.append(self.leaf("robot_field", f.get("field_name"), n, f.get("field_values")))
        for n, (k, x) in enumerate(r.get("gripper_fields") or []):
            if x is not None:
                below.append(self.leaf("gripper_field", k, n, x))
        own = {k: r.get(k) for k in ("robot_type", "controller_type", "gripper_type")}
        return self.leaf("robot", str(i), i, own, below)

    def observable(self, name: str, i: int, v: dict) -> tuple:
        fields = _part(v.get("fields"))
        below = [self.leaf("observable_field", k, n, x) for n, (k, x) in enumerate(fields.items() if isinstance(fields, dict) else []) if _part(x) is not None]
        return self.leaf("observable", name, i, {k: x for k, x in v.items() if k != "fields"}, below)


def _decode(with_content: bool):
    schema = pa.schema([("snapshot_id", pa.int64()), ("salt", pa.int32()), ("child_kind", pa.string()), ("parent_key", pa.string()), ("child_key", pa.string()), ("ordinal", pa.int32()), ("parent_hash", pa.string()), ("child_hash", pa.string()), ("content", pa.string())])

    def clean(s: Any) -> Any:  # a lone surrogate cannot be stored as UTF-8
        return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()

    def flush(d: Decoder) -> pa.RecordBatch:
        cols = list(zip(*d.rows, strict=True))
        out = [pa.array([clean(x) for x in c] if pa.types.is_string(f.type) else c, f.type) for c, f in zip(cols, schema, strict=True)]
        d.rows = []
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(with_content)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for row in zip(*(s.column(n).to_pylist() for n in ("snapshot_id", "json_state", "robots", "observables")), strict=True):
                    d.snapshot(*row)
                    if len(d.rows) >= BATCH_ROWS:
                        yield flush(d)
        if d.rows:
            yield flush(d)

    return run


def flatten_snapshots(snapshots: DataFrame, *, content: bool = True) -> DataFrame:
    """A row for each object of each snapshot, under its parent; see BRIDGE.

    ``content`` adds its canonical JSON to the first rows in which a task meets
    it, and leaves it null in the others. Null, unreadable and truncated texts
    give the snapshot's own row only, as far as no other part can be read. Null
    elements keep their position and give no row. Rows with a null snapshot_id
    are kept under null. Repeated rows of a snapshot repeat its records; see
    :func:`found_records`. JSON may be nested to any depth.
    """
    part = snapshots.select("snapshot_id", "json_state", "robots", "observables")
    return part.mapInArrow(_decode(content), BRIDGE)


def distinct_nodes(decoded: DataFrame) -> DataFrame:
    """Each object once: node_hash, kind, content, and the number of its occurrences."""
    return decoded.groupBy(F.col("child_hash").alias("node_hash"), F.col("child_kind").alias("kind")).agg(F.first("content", ignorenulls=True).alias("content"), F.count(F.lit(1)).alias("occurrences"))


def tables(snapshots: DataFrame, *, content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, bridge) from one pass over the snapshots, which is stored in the checkpoint folder. Nodes are kept once a salt."""
    decoded = stored(flatten_snapshots(snapshots, content=content).withColumns({c: F.unhex(c) for c in ("parent_hash", "child_hash")}))
    nodes = decoded.groupBy("salt", F.col("child_hash").alias("node_hash")).agg(F.first("child_kind").alias("kind"), F.first("content", ignorenulls=True).alias("content"), F.count(F.lit(1)).alias("occurrences"))
    return nodes, decoded.select("snapshot_id", "salt", "parent_key", "child_key", "ordinal", "parent_hash", "child_hash")


def found_records(snapshots: DataFrame) -> DataFrame:
    """The places in which records with a kind of their own stand, without repeats and the snapshots' own rows.

    The bridge says where a node stands, the nodes say what stands there; they meet by (salt, hash).
    """
    nodes, bridge = tables(snapshots, content=False)
    records = nodes.filter(~F.col("kind").isin("snapshot", "object")).select("salt", F.col("node_hash").alias("child_hash"), F.col("kind").alias("child_kind"))
    return bridge.join(records, ["salt", "child_hash"]).select("snapshot_id", "child_kind", "parent_key", "child_key").distinct()
