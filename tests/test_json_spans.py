"""The first JSON value in prose, against the decoder tried at every bracket."""

import json
import random
import time

import pytest

from tallystone.functions.json_spans import first_value


def plain(text):
    for start, char in enumerate(text):
        if char in "{[":
            try:
                return text[start : json.JSONDecoder().raw_decode(text, start)[1]]
            except ValueError:
                continue
    return None


def test_random_texts_match_the_decoder():
    rng = random.Random(6)
    parts = ['{', '}', '[', ']', '"', '\\"', ':', ',', ' ', '"a"', '"a": ', '1', '-0.5e3', '01', 'true', 'NaN', '-Infinity', 'x', '\n', '\\u12', '"é[1]"', '{"b": [1, 2]}', '[]', '{}', '"k {"']
    seen = 0
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = plain(text)
        assert first_value(text) == want, text
        seen += want is not None
    assert seen > 5_000
    assert first_value(None) is None and first_value("") is None and first_value('say [1, {"a": 2}') == '{"a": 2}'


@pytest.mark.parametrize("unit", ["[", "{", '{"a":[', "[{", '["', '{"a":"', '[1,', "[[1],", '"[', "{[", '[ "x [', '{"a":{}'])
def test_a_megabyte_of_brackets_takes_a_second(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    first_value(text)
    assert time.perf_counter() - start < 4
    deep = "[" * 200_000 + "]" * 200_000
    assert first_value("x " + deep) is None
