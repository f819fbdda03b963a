import json

from compare import SMALL

from stepweave.operators import nested
from stepweave.runtime import table

SCHEMA = "snapshot_id long, json_state string, robots array<struct<robot_type string, controller_type string, controller_fields map<string,array<double>>, robot_fields array<struct<field_name string, field_values array<double>>>, gripper_type string, gripper_fields map<string,double>>>, observables string, content string, ordinal int"


def records(spark, state=None, robots=None, observables=None, sid=1):
    text = state if state is None or isinstance(state, str) else json.dumps(state)
    seen = observables if observables is None or isinstance(observables, str) else json.dumps(observables)
    df = spark.createDataFrame([(sid, text, robots, seen, "x", 1)] * 2, SCHEMA)
    out = [tuple(r)[1:] for r in nested.found_records(df).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_objects_by_key_by_name_and_wrapped(spark):
    by_key = {"objects": {"a b": {}, "null": {"x": 1}, "c": None}, "fixtures": json.dumps({"f.1": {"y": 2}})}
    want = {("scene_object", "", "a b"), ("scene_object", "", "null"), ("fixture", "", "f.1")}
    assert records(spark, by_key) == want
    assert records(spark, json.dumps(json.dumps(by_key))) == want
    assert records(spark, {"objects": [{"name": "a b"}, None, {"name": "null", "x": 1}, "text"], "fixtures": [json.dumps({"name": "f.1"})]}) == want


def test_contacts_and_goals(spark):
    state = {"contact_and_grasp": {"contacts": [None, {"geom1_owners": ["o:1", None, "o:1"], "geom2_owners": "r:0"}, {}]}, "goals": json.dumps({"goal_predicates": {"predicate": ["on"]}})}
    want = {("contact", "", "1"), ("contact", "", "2"), ("contact_owner", "1", "geom1_owners.0"), ("contact_owner", "1", "geom1_owners.2"), ("contact_owner", "1", "geom2_owners.0"), ("goal_predicate", "", "0")}
    assert records(spark, state) == want
    assert records(spark, {"contact_and_grasp": {"contacts": {}}, "goals": {"goal_predicates": None}}) == set()


def test_robots(spark):
    r = ("Arm", None, {"kp": [1.0], "kd": None}, [None, ("torques", [float("nan")]), (None, None)], None, {"speed": None, "act": 0.5})
    want = {("robot", "", "1"), ("controller_field", "1", "kp"), ("robot_field", "1", "torques"), ("gripper_field", "1", "act")}
    assert records(spark, robots=[None, r]) == want


def test_observables(spark):
    o = {"x": {"fields": {"a": 0, "b": None, "c": ""}}, "y": {"fields": json.dumps({"d": False})}, "z": None, "w": {}}
    want = {("observable", "", k) for k in "xyw"} | {("observable_field", "x", "a"), ("observable_field", "x", "c"), ("observable_field", "y", "d")}
    assert records(spark, observables=o) == want


def test_unreadable_texts_and_bare_numbers(spark):
    assert records(spark, '{"objects": {"a": {}', observables="") == set()
    assert records(spark, "[]", observables="null") == set()
    assert records(spark, '{"objects": {"a": {"v": [NaN, -Infinity]}}}') == {("scene_object", "", "a")}
    assert records(spark, "[" * 100_000) == set()
    assert records(spark, '{"objects": {"\\ud800": {}}}') == {("scene_object", "", "?")}


def test_empty_table(spark):
    assert nested.flatten_snapshots(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_records_are_one_node_and_the_bridge_rebuilds_the_nesting(spark):
    state = {"objects": {"a": {"x": 1, "y": 2}, "b": {"y": 2, "x": 1}}, "contact_and_grasp": {"contacts": [{"d": 1, "geom1_owners": ["o"]}, {"d": 1, "geom1_owners": ["p"]}]}}
    df = spark.createDataFrame([(1, json.dumps(state), None, None, "x", 1), (2, json.dumps(state), None, None, "x", 1)], SCHEMA)
    bridge = nested.flatten_snapshots(df)
    nodes = {r.node_hash: r for r in nested.distinct_nodes(bridge).collect()}
    kinds = [n.kind for n in nodes.values()]
    assert kinds.count("scene_object") == 1 and kinds.count("snapshot") == 1 and kinds.count("contact") == 2  # equal content, unequal owners
    rows = bridge.filter("snapshot_id = 2").orderBy("ordinal").collect()
    root = next(r for r in rows if r.child_kind == "snapshot")
    rebuilt: dict = json.loads(nodes[root.child_hash].content)
    for r in rows:
        if r.parent_hash != root.child_hash:
            continue
        value = json.loads(nodes[r.child_hash].content)
        if r.child_kind == "scene_object":
            rebuilt.setdefault("objects", {})[r.child_key] = value
        else:
            value["geom1_owners"] = [json.loads(nodes[k.child_hash].content) for k in rows if k.parent_hash == r.child_hash]
            rebuilt["contact_and_grasp"].setdefault("contacts", []).append(value)
    assert rebuilt == state


def test_same_cases_as_a_plain_walk_over_the_data(spark):
    """A second reading of the definition, written as a recursive walk."""

    def load(x):
        while isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return None
        return x

    def part(d, *keys):
        for k in keys:
            d = load(d)
            d = d.get(k) if isinstance(d, dict) else None
        return load(d)

    def listed(p):
        return [p] if isinstance(p, dict) and p else p if isinstance(p, list) else []

    want = set()
    for s in table(spark, SMALL, "telemetry_snapshots").collect():
        for kind, key in (("scene_object", "objects"), ("fixture", "fixtures")):
            p = part(s.json_state, key)
            pairs = p.items() if isinstance(p, dict) else [(x.get("name"), x) for x in p if x] if isinstance(p, list) else []
            want |= {(s.snapshot_id, kind, "", k) for k, v in pairs if isinstance(v, dict)}
        for i, c in enumerate(listed(part(s.json_state, "contact_and_grasp", "contacts"))):
            if c is not None:
                want.add((s.snapshot_id, "contact", "", str(i)))
                for side in ("geom1_owners", "geom2_owners"):
                    o = c.get(side)
                    want |= {(s.snapshot_id, "contact_owner", str(i), f"{side}.{j}") for j, x in enumerate([o] if isinstance(o, str) else o or []) if x is not None}
        want |= {(s.snapshot_id, "goal_predicate", "", str(i)) for i, g in enumerate(listed(part(s.json_state, "goals", "goal_predicates"))) if g is not None}
        for i, r in enumerate(s.robots or []):
            if r is not None:
                want.add((s.snapshot_id, "robot", "", str(i)))
                want |= {(s.snapshot_id, "controller_field", str(i), k) for k, v in (r.controller_fields or {}).items() if v is not None}
                want |= {(s.snapshot_id, "gripper_field", str(i), k) for k, v in (r.gripper_fields or {}).items() if v is not None}
                want |= {(s.snapshot_id, "robot_field", str(i), f.field_name) for f in r.robot_fields or [] if f is not None}
        for k, v in (load(s.observables) or {}).items():
            if v is not None:
                want.add((s.snapshot_id, "observable", "", k))
                want |= {(s.snapshot_id, "observable_field", k, f) for f, x in (part(v, "fields") or {}).items() if x is not None}
    got = nested.found_records(table(spark, SMALL, "telemetry_snapshots")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_objects_at_any_depth_are_nodes(spark):
    inner = {"z": [1, [2, {"deep": {"q": {}}}]], "a": None}
    state = {"objects": {"a": {"links": [inner, inner], "pose": inner}}, "extra": {"pose": inner}}
    df = spark.createDataFrame([(1, json.dumps(state), None, None, "x", 1)], SCHEMA)
    decoded = nested.flatten_snapshots(df)
    nodes = {r.node_hash: r for r in nested.distinct_nodes(decoded).collect()}
    rows = decoded.collect()
    same = {r.child_hash for r in rows if r.child_key in ("links.0", "links.1", "pose")}
    assert len(same) == 1 and nodes[same.pop()].occurrences == 4
    assert {(r.parent_key, r.child_key) for r in rows if r.child_kind == "object"} == {("a", "links.0"), ("a", "links.1"), ("a", "pose"), ("", "extra"), ("extra", "pose"), ("links.0", "z.1.1"), ("links.1", "z.1.1"), ("pose", "z.1.1"), ("z.1.1", "deep")}

    def built(h):
        return json.loads(nodes[h].content, object_hook=lambda d: built(d["#"]) if set(d) == {"#"} else d)

    assert built(next(r.child_hash for r in rows if r.child_kind == "scene_object")) == state["objects"]["a"]


def test_very_deep_texts_are_read_and_stay_apart(spark):
    def text(leaf, open_="[", close="]"):
        return '{"objects": {"a": {"v": ' + open_ * 50_000 + leaf + close * 50_000 + "}}}"

    assert records(spark, text("1")) == {("scene_object", "", "a")}
    assert records(spark, text("1")[:-1]) == set()
    assert records(spark, text("1", '{"k":', "}")) == {("scene_object", "", "a")}
    hashes = [nested.content_of(nested.read_json(text(x)))[0] for x in ("1", "2", "1")]
    assert hashes[0] == hashes[2] != hashes[1]


def test_the_deep_parser_reads_like_the_library():
    good = ['{"a": [1, -2.5e3, "x\\n", null, true, false, NaN, -Infinity], "b": {}, "c": []}', " [ ] ", '"t"', "0", "[[],{}]"]
    for t in good:
        assert str(nested.parse_deep(t)) == str(json.loads(t))
    for t in ("", "[", "]", "{", '{"a"}', '{"a":}', "[1,]", '{"a":1,}', "[1 2]", "01", "1 2", "nul", '"x', "{1:2}", "[}", '{"a":1]'):
        try:
            nested.parse_deep(t)
        except ValueError:
            continue
        raise AssertionError(t)
