import pytest

from tidemill import rules


def test_yaml_subset():
    text = """
# head
a: 1
b: -2.5
c: "x: y"   # tail
d: [ ]
e:
  - one
  - "two # not a comment"
  - k: v
    l: 3
f: {}
g: yes it is
h: true
i: null
"""
    got = rules.parse(text.replace("[ ]", "[]"))
    assert got == {
        "a": 1, "b": -2.5, "c": "x: y", "d": [], "e": ["one", "two # not a comment", {"k": "v", "l": 3}], "f": {}, "g": "yes it is",
        "h": True, "i": None,
    }
    assert rules.parse("") == {} and rules.parse("# only\n") == {}
    with pytest.raises(ValueError):
        rules.parse("- a\n- b\n")


def test_comment_modes():
    assert rules.parse("k:\n  - c#\n  - c\n") == {"k": ["c#", "c"]}
    assert rules.parse("k:\n  - c#\n  - c\n", "naive") == {"k": ["c", "c"]}


def test_empty_phrase_is_refused():
    with pytest.raises(ValueError):
        rules.build({"hard_filters": {"title_contains": [""]}})


def test_integer_looking_value_becomes_text(spark):
    from pyspark.sql import functions as F

    from tidemill.functions.text import latex

    assert spark.range(1).select(latex(F.lit(2025))).first()[0] == "2025"
