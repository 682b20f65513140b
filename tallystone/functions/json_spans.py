"""The first JSON object or array inside prose, found in time linear in the text.

A bracket that starts no value is not tried alone: an attempt that fails takes with it all brackets
still open at that point, since each of them would meet the same error, and remembers those that were
closed before, since each of them is a value. So the text is gone over once for each way of reading
its quotes, however many brackets it has.
"""

from __future__ import annotations

import json
import re

BLANK = re.compile(r"[ \t\n\r]*")
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
SCALAR = re.compile(
    STRING.pattern + r"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity"
)
# Brackets whose first token may start a value; the others need no attempt.
_OBJECT = r"\{(?=[ \t\n\r]*(?:\}|" + STRING.pattern + r"[ \t\n\r]*:))"
OPEN = re.compile(
    _OBJECT + r"|\[(?=[ \t\n\r]*(?:" + _OBJECT + r"|[\[\]\-0-9tfnNI]|" + STRING.pattern + r"[ \t\n\r]*[,\]]))"
)
ARRAYS = re.compile(r"\[+")
CLOSES = {"{": "}", "[": "]"}
VALUE, VALUE_OR_END, KEY, KEY_OR_END, AFTER = range(5)


def attempt(text: str, start: int, closed: dict[int, int], failed: set[int]) -> None:
    """Read a value at a bracket; note the ends of all values in it, or the brackets left open."""
    stack, expect, pos = [], VALUE, start
    while True:
        pos = BLANK.match(text, pos).end()
        char = text[pos : pos + 1]
        if expect in (VALUE, VALUE_OR_END):
            if char == "[":
                end = ARRAYS.match(text, pos).end()
                stack.extend((place, char) for place in range(pos, end))
                pos, expect = end, VALUE_OR_END
                continue
            if char == "{":
                stack.append((pos, char))
                pos, expect = pos + 1, KEY_OR_END
                continue
            if not (char == "]" and expect == VALUE_OR_END):
                scalar = SCALAR.match(text, pos)
                if scalar is None:
                    break
                pos, expect = scalar.end(), AFTER
                continue
        elif expect in (KEY, KEY_OR_END):
            if not (char == "}" and expect == KEY_OR_END):
                key = STRING.match(text, pos)
                if key is None:
                    break
                pos = BLANK.match(text, key.end()).end()
                if text[pos : pos + 1] != ":":
                    break
                pos, expect = pos + 1, VALUE
                continue
        elif char == ",":
            pos, expect = pos + 1, KEY if stack[-1][1] == "{" else VALUE
            continue
        elif char != CLOSES[stack[-1][1]]:
            break
        pos += 1
        closed[stack.pop()[0]] = pos
        if not stack:
            return
        expect = AFTER
    failed.update(place for place, _ in stack)


def first_value(text: str | None) -> str | None:
    """The value of the first bracket that starts one; NULL where none does or the decoder cannot follow it."""
    if text is None:
        return None
    closed: dict[int, int] = {}
    failed: set[int] = set()
    decoder = json.JSONDecoder()
    for match in OPEN.finditer(text):
        start = match.start()
        if start not in closed and start not in failed:
            attempt(text, start, closed, failed)
        if start in closed:
            try:
                decoder.raw_decode(text[start : closed[start]])
            except ValueError:  # a number of too many digits
                continue
            except RecursionError:
                return None
            return text[start : closed[start]]
    return None
