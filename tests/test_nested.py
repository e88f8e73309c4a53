"""Nested records against a plain recursive walk, with interval labels checked."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.operators import nested
from lodestrand.sources.tables import table

trees = st.recursive(st.none() | st.booleans() | st.integers() | st.text("ab.", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


def walk(o, path, parent, element, out):
    if isinstance(o, dict):
        if element:
            out.append((parent, path))
            parent = path
        for k, v in o.items():
            walk(v, f"{path}.{k}", parent, False, out)
    elif isinstance(o, list):
        for i, v in enumerate(o):
            walk(v, f"{path}[{i}]", parent, True, out)
    return out


@settings(max_examples=200, deadline=None)
@given(trees)
def test_labels(tree):
    rows = nested.label(tree, "c")
    assert [r[0] for r in rows] == list(range(len(rows))) and sorted(r[1] for r in rows) == list(range(len(rows)))
    elements = [r for r in rows if r[4]]
    found = []
    for r in elements:
        around = [e for e in elements if e[0] < r[0] and e[1] > r[1]]
        assert len(around) == r[2]
        found.append((max(around)[5] if around else "", r[5]))
    assert sorted(found) == sorted(walk(tree, "c", "", False, []))


def test_unpacking():
    x = {"a": [{"b": 1}]}
    s = json.dumps(x)
    assert nested.unpack(s) == nested.unpack("﻿ " + s) == nested.unpack(json.dumps(s)) == nested.unpack(f"```json\n{s}\n```") == nested.unpack(f"Result: {s} (end)") == x
    assert nested.unpack(None) is nested.unpack("") is nested.unpack(s[:-2]) is nested.unpack("text") is nested.unpack(json.dumps(s)[:-4]) is None
    assert nested.unpack('{"a": NaN}')["a"] != 0


def test_tables(spark, data):
    q = table(spark, data, "last_query_result")
    nodes = nested.nodes(q, "result_id", ["ranked_evidence", "channel_scores", "retrieval_meta"]).cache()
    got = {(r.record_id, r.parent_path, r.path) for r in nested.object_table(nodes).collect()}
    want = set()
    for r in q.collect():
        for c in ("ranked_evidence", "channel_scores", "retrieval_meta"):
            want |= {(r.result_id, *x) for x in walk(nested.unpack(r[c]), c, "", False, [])}
    assert got == want and got
    paths = {(r.record_id, r.path) for r in nodes.collect()}
    assert all(r.parent_path == "" or (r.record_id, r.parent_path) in paths for r in nested.value_table(nodes).collect())
