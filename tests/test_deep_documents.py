"""Post-game documents that nest deeper than a decoder with recursion can follow."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchlens import schema
from matchlens.operators import postgame

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=3), inner, max_size=4),
    max_leaves=20,
)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1, "\t"]))
def test_reads_like_the_library(value, indent):
    text = json.dumps(value, indent=indent)
    assert postgame._read_deep(f" {text}\n") == value


@settings(max_examples=300, deadline=None)
@given(VALUES, st.randoms(use_true_random=False))
def test_rejects_what_the_library_rejects(value, rng: random.Random):
    text = list(json.dumps(value))
    for _ in range(rng.randrange(1, 3)):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randrange(2)] = rng.choice(["", ",", "]", "}", '"', ":", "[", "1", " "])
    text = "".join(text)
    try:
        wanted = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            postgame._read_deep(text)
    else:
        assert postgame._read_deep(text) == wanted


def test_repeated_keys_and_constants():
    assert postgame._read_deep('{"a":1,"a":{"b":[]}}') == {"a": {"b": []}}
    assert postgame._read_deep("[Infinity,-Infinity,1e400,-0,true]") == [float("inf"), -float("inf"), float("inf"), 0, True]


@pytest.mark.parametrize("opening, closing", [('{"x":', "}"), ("[", "]"), ('{"economy":', "}"), ('{"economy":[', "]}")])
def test_records_at_any_depth(opening, closing):
    depth = 100_000
    text = opening * depth + '{"player_id":3,"food":5,"wood":6}' + closing * depth
    start = time.monotonic()
    found = [r for r in postgame._records(postgame._decoded(text), None) if r[1] == 3]
    assert found == [(postgame.ANYWHERE, 3, [5.0, 6.0, 0.0, 0.0])]
    assert time.monotonic() - start < 10
    assert postgame._decoded(text[:-1]) is None


def test_totals_of_a_deep_document(spark):
    deep = '{"a":[' * 50_000 + '{"player_id":2,"food":1,"gold":4}' + "]}" * 50_000
    rows = [(1, deep, None), (2, deep[:-2], None), (3, '{"players":[{"id":1,"food":2,"wood":3}]}', None)]
    found = postgame.postgame_totals(spark.createDataFrame(rows, schema.POSTGAME))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1.0, 0.0, 4.0, 0.0), (3, 1, 2.0, 3.0, 0.0, 0.0)]
