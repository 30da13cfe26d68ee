import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import nested

SCHEMA = "raw_id bigint, payload string, received_at string"


def paths(text):
    record = nested.decode_object(text)
    return None if record is None else [(k, p) for tag, k, p, _ in nested.visit(record) if tag in nested.VALUE_MEMBERS.values()]


def test_values_and_owners():
    text = json.dumps({"details": json.dumps({"COLOR": ["Red", "", None, True, 5]}), "variants": [{"features": [{"text": "a", "tags": ["b"]}, "c", " "], "price": 3}], "Categories": "x > y", "color": {"main": {"deep": 1.5}}})
    assert paths(text) == [("/details/COLOR/0", ""), ("/details/COLOR/4", ""), ("/variants/0/features/0/text", "/variants/0/features/0"), ("/variants/0/features/0/tags/0", "/variants/0/features/0"), ("/variants/0/features/1", "/variants/0"), ("/Categories", ""), ("/color/main/deep", "")]


@pytest.mark.parametrize("text", [None, "", "  ", "[1]", "3", '{"a": ', '{"color": NaN}', "null", '{"color": "x"} tail'])
def test_no_object_gives_nothing(text):
    assert paths(text) is None


def test_names_are_escaped():
    assert paths('{"a/b": {"c~d": {"color": "x"}}}') == [("/a~1b/c~0d/color", "")]


def test_deep_records():
    deep = '{"features":' * 20_000 + '"x"' + "}" * 20_000
    assert len(paths(deep)) == 1
    assert paths('{"features":' * 20_000 + '"x"') is None


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12))
def test_iterative_decoder_agrees(value):
    for text in (json.dumps(value), json.dumps(value, indent=1)):
        assert nested._decode_deep(text) == value


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='{}[],:"ab1 -.etrufalsn\\', max_size=14))
def test_iterative_decoder_rejects_alike(text):
    try:
        wanted = json.JSONDecoder(parse_constant=nested._not_json).decode(text)
    except ValueError:
        with pytest.raises(ValueError):
            nested._decode_deep(text)
    else:
        assert nested._decode_deep(text) == wanted


def test_tables(spark, tmp_path, rows):
    data = [(1, '{"features": ["a", {"text": "b"}]}', "x"), (1, '{"features": ["a"]}', "x"), (2, None, "x"), (None, '{"color": 1}', "x")]
    tagged = nested.shred(spark.createDataFrame(data, SCHEMA))
    assert rows(nested.value_rows(tagged)) == sorted([(1, "/features/0", ""), (1, "/features/1/text", "/features/1"), (1, "/features/0", ""), (None, "/color", "")], key=repr)
    nested.write_tables(tagged, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows(nested.apply_schema(back, "features"), "raw_id", "row_key", "parent_key", "value", "kind") == sorted([(1, "/features/0", "", "a", "string"), (1, "/features/1/text", "/features/1", "b", "string"), (1, "/features/0", "", "a", "string")], key=repr)
    assert rows(nested.apply_schema(back, "object"), "row_key", "members") == [("/features/1", ["text"])]
    assert nested.shred(spark.createDataFrame([], SCHEMA)).count() == 0
