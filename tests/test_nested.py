"""Nested records against a plain recursive reading of the whole JSON value."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagestrata.operators import nested
from pagestrata.runtime import table


def listed(value, text_elements=False):
    if isinstance(value, str):
        if value.strip().startswith("["):
            try:
                return json.loads(value)
            except ValueError:
                pass
        return [value] if text_elements and value.strip() else []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def brute(payload):
    try:
        root = json.loads((payload or "").removeprefix("﻿"))
    except ValueError:
        return set()
    if isinstance(root, list):
        root = root[0] if len(root) == 1 else None
    if isinstance(root, dict) and isinstance(root.get("result"), dict):
        root = root["result"]
    elif isinstance(root, dict) and isinstance(root.get("data"), dict) and isinstance(root["data"].get("crawl"), dict):
        root = root["data"]["crawl"]
    if not isinstance(root, dict):
        return set()
    out = set()
    for i, page in enumerate(listed(root.get("pages"))):
        if page is not None:
            out.add(("page", 0, i))
            for kind, member in (("internal_link", "internal_links"), ("image", "images")):
                out |= {(kind, i, j) for j, x in enumerate(listed(page.get(member))) if x is not None}
    issues = root.get("issues")
    if isinstance(issues, dict) and "issues" in issues:
        issues = issues["issues"]
    for i, issue in enumerate(listed(issues)):
        if issue is not None:
            out.add(("issue", 0, i))
            out |= {("issue_url", i, j) for j, x in enumerate(listed(issue.get("urls"), True)) if x is not None}
    return out


def test_child_records_match_brute_force(spark):
    results = table(spark, "/root/testdata/sf0.01", "crawl_results")
    expected = {(r.result_id, *x) for r in results.collect() for x in brute(r.payload)}
    got = [(r.result_id, r.kind, r.parent_pos, r.child_pos) for r in nested.child_records(results).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 500


def test_tables_agree_with_child_records(spark, sf_dir):
    results = table(spark, sf_dir, "crawl_results")
    kinds = {r.kind: r["count"] for r in nested.child_records(results).groupBy("kind").count().collect()}
    tables = nested.tables(results)
    for name, kind in (("pages", "page"), ("internal_links", "internal_link"), ("images", "image"), ("issues", "issue"), ("issue_urls", "issue_url")):
        assert tables[name].count() == kinds.get(kind, 0)


@pytest.mark.parametrize("payload", [None, "", " ", "{", '{"pages": [{}]} x', '{"pages": [{"url": "a}]}', "[1, 2]", "7", '"text"', "[", "{'a': 1}", '{"a": 01}'])
def test_incomplete_or_foreign_payloads_give_nothing(payload):
    assert nested.triples_of(payload) == []


def test_single_members_strings_and_nulls():
    payload = '﻿[{"pages": {"url": "u", "internal_links": "[null, {\\"url\\": \\"x\\"}]", "images": null}, "issues": {"check": "c", "urls": "http://a"}}]'
    keys = {(p, tuple(o)) for p, o, _ in nested.triples_of(payload) if p.endswith("[]")}
    assert keys == {("pages[]", (0,)), ("pages[].internal_links[]", (0, 1)), ("issues[]", (0,)), ("issues[].urls[]", (0, 0))}


def test_depth_is_not_bound():
    deep = "[" * 3_000 + "]" * 3_000
    assert nested.triples_of('{"pages": [{"x": ' + deep + "}]}") == [("pages[]", [0], None)]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20), st.sampled_from([None, 1]))
def test_scanner_sees_every_leaf(value, indent):
    def leaves(v, steps=()):
        if isinstance(v, dict):
            yield steps, nested.OBJECT
            for k, x in v.items():
                yield from leaves(x, steps + (k,))
        elif isinstance(v, list):
            yield steps, nested.ARRAY
            for k, x in enumerate(v):
                yield from leaves(x, steps + (k,))
        else:
            yield steps, v if isinstance(v, str) or v is None else json.dumps(v)

    assert list(nested.scan(json.dumps(value, indent=indent))) == list(leaves(value))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "result_id long, payload string, id long, path string, kind string")
    assert nested.child_records(empty).count() == 0
    one = spark.createDataFrame([(1, '{"pages":[{"url":"a"}]}', 5, "p", "k"), (1, '{"pages":[{"url":"a"}]}', 6, "p", "k"), (None, "{}", 7, None, None)], empty.schema)
    assert [tuple(r) for r in nested.child_records(one).collect()] == [(1, "page", 0, 0)]
