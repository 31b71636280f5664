import pytest
import json

from hypothesis import given, settings, strategies as st

from touchline.operators.markets import market_nodes, markets, named_teams, ranges
from touchline.operators.nested import inside, label, label_nodes, nodes_of, parse

values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "item"]), c, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(values)
def test_intervals_nest_or_part(value):
    nodes = label(value, {"item": "item"})
    assert len({n[0] for n in nodes}) == len(nodes)
    for a in nodes:
        for b in nodes:
            if a[0] < b[0]:
                inside_ = b[1] < a[1]
                apart = b[1] > a[1]
                assert inside_ != apart


def test_parse_takes_only_json():
    assert parse(None) is None and parse("") is None and parse("{") is None and parse("NaN") is None
    assert parse('"{\\"a\\": 1}"') == {"a": 1}
    assert label({"item": []}, {"item": "item"}) == []


def payload(**extra):
    return json.dumps({"event": {"event_ticker": "E", "markets": [{"ticker": "M1", "price_ranges": [{"start": "0", "end": "1"}], "custom_strike": {"soccer_team": ["A", {"name": "B"}]}}, {"ticker": "M2", "custom_strike": json.dumps({"soccer_team": "C"})}, {"ticker": "M3"}]}, **extra})


def test_market_tables(spark):
    rows = [(1, payload(), "x"), (1, payload(), "x"), (2, "{broken", "x"), (None, payload(cursor=1), "y"), (3, None, "x"), (4, json.dumps(payload()), "x"), (5, "", "x"), (6, '{"markets": [null, "", 3]}', "x")]
    df = spark.createDataFrame(rows, "pull_id bigint, payload string, ticker string")
    nodes = market_nodes(df)
    got = {(r.event_ticker, r.ticker, r.soccer_team) for r in named_teams(nodes).collect()}
    assert got == {("E", "M1", "A"), ("E", "M1", "B"), ("E", "M2", "C"), ("E", "M3", "")}
    assert markets(nodes).where("pull_id = 1").count() == 3
    assert ranges(nodes).where("pull_id is null").select("event_ticker", "ticker", "range_end").collect()[0] == ("E", "M1", "1")
    assert market_nodes(df.limit(0)).count() == 0


def test_deep_records_and_containment(spark):
    deep = {"item": {"id": 0}}
    for i in range(1, 300):
        deep = {"item": {"id": i, "child": deep["item"]}, "other": 1}
    df = spark.createDataFrame([(json.dumps(deep),)], "payload string")
    nodes = label_nodes(df, [], "payload", {"item": "item", "child": "child"})
    top = nodes_of(nodes, [], "item", {"id": "id"})
    low = nodes_of(nodes, [], "child", {"child_id": "id"})
    assert top.count() == 1 and low.count() == 299
    assert inside(low, top, [], "inner").count() == 299


def test_depth_is_no_limit():
    import json

    from touchline.operators.nested import _read_deep, label, parse

    deep = '{"events": [' * 60_000 + '{"markets": [{"ticker": "T"}]}' + "]}" * 60_000
    assert [n[3] for n in label(parse(deep), {"markets": "market"})] == ["market"]
    assert parse(deep[:-1]) is None and parse("[" * 200_000) is None
    wrapped = json.dumps({"a": 1})
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    assert parse(wrapped) == {"a": 1}
    for text in ('{"a": [1, {"b": null}, "x", -2.5e3, true, []], "c": {}}', "[]", " [ 1 , 2 ] ", '{"a": {"b": [[]]}, "a": 2}', '"x"'):
        assert _read_deep(text) == json.loads(text)
    for text in ("[1,]", '{"a":1,}', "{1: 2}", '{"a" 1}', "[1 2]", "[1]]", "", "[", '{"a":', "[NaN]"):
        with pytest.raises(ValueError):
            _read_deep(text)
