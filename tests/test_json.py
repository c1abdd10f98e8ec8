import json
import random

import pytest

from maskline.operators import validate


def strict(text):
    """The plain parser: repeated keys at any depth, NaN and infinities, and anything after the value are errors."""

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def plain(text):
    try:
        top = strict(text)
    except (ValueError, TypeError, RecursionError):
        return False, False, []
    if not isinstance(top, dict) or not isinstance(top.get("identifiers"), list):
        return False, False, []
    items = []
    for x in top["identifiers"]:
        own = isinstance(x, dict)
        keys = own and set(x) == {"exact_text", "identifier_type"}
        text_ = [v if isinstance(v, str) else None for v in ((x["exact_text"], x["identifier_type"]) if keys else (None, None))]
        items.append((own, keys, *text_))
    return True, set(top) != {"identifiers"}, items


def told(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(2)
    done = rows.select("id", validate.parse_content(rows["content"]).alias("p"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return {r.id: (r.p.usable, r.p.extra_keys, [tuple(x) for x in r.p["items"]]) for r in done.collect()}


ITEM = '{"exact_text": "a", "identifier_type": "01_NAME"}'
CASES = [
    None, "", " ", "x", "null", "3", '"identifiers"', "[]", "{}", '{"identifiers": null}', '{"identifiers": {}}', '{"identifiers": "[]"}', '{"identifiers": 3}',
    '{"identifiers": []}', ' \t\n\r{"identifiers": []} \n', '{"identifiers": [], "more": 1}', '{"IDENTIFIERS": []}', '{"identifiers": [] }x', '{"identifiers": []} {}', '{"identifiers": []}}', '{"identifiers": []}]', '{"identifiers": []}]}', '{"identifiers": []}],"b":[1',
    '{"identifiers": []},', '{"identifiers": []},1', '{"identifiers": []}, "v": 2', '{"identifiers": []}}, {"a": 1', ',{"identifiers": []}', '], [{"identifiers": []}', '{"identifiers": [],}', '{"identifiers": [1,]}', "{'identifiers': []}", '{identifiers: []}', '{"identifiers": []} // c', '/* c */{"identifiers": []}',
    f'{{"identifiers": [{ITEM}]}}', f'{{"identifiers": [{ITEM}, {ITEM}, 3, null, "s", [], {{}}, true]}}', '{"identifiers": [{"exact_text": 3, "identifier_type": null}]}', '{"identifiers": [{"exact_text": "", "identifier_type": ["x"]}]}', '{"identifiers": [{"exact_text": "a"}]}', '{"identifiers": [{"exact_text": "a", "identifier_type": "b", "c": 1}]}', '{"identifiers": [{"exact_text": "a", "other": "b"}]}',
    '{"identifiers": [], "identifiers": []}', '{"identifiers": [{"exact_text": "a", "exact_text": "b", "identifier_type": "c"}]}', '{"identifiers": [{"exact_text": {"x": {"y": 1, "y": 2}}, "identifier_type": "c"}]}', '{"identifiers": [[{"k": 1, "k": 1}]]}', '{"identifiers": [{"a": 1, "A": 2}]}',
    '{"identifiers": [NaN]}', '{"identifiers": [Infinity]}', '{"identifiers": [-Infinity]}', '{"identifiers": [], "x": NaN}', '{"identifiers": [1e400, -0, 0.1e-5, 12345678901234567890123456789012345678901234567890]}', '{"identifiers": [01]}', '{"identifiers": [1.]}', '{"identifiers": [+1]}', '{"identifiers": [.5]}', '{"identifiers": [-]}', '{"identifiers": [0x1]}', '{"identifiers": [' + "9" * 900 + "]}",
    '{"identifiers": [{"exact_text": "\\u00e9\\n\\t\\"\\\\ \\ud83d\\ude00", "identifier_type": "\U0001f600"}]}', '{"identifiers": [{"exact_text": "a\nb", "identifier_type": "c"}]}', '{"identifiers": [{"exact_text": "a\tb", "identifier_type": "c"}]}', '{"identifiers": [{"exact_text": "\\x", "identifier_type": "c"}]}', '{"identifiers": [{"exact_text": "open', '{"identifiers": [', '﻿{"identifiers": []}', '{"identifiers": []} ', '{"identifiers": [tru]}', '{"identifiers": [TRUE]}',
    '{"identifiers": [' + "[" * 300 + "]" * 300 + "]}", '{"identifiers": [' + "[" * 300 + "]" * 299 + "]}", '{"identifiers": [' + "[" * 200_000 + "]" * 200_000 + "]}", '{"a": ' * 100 + "1" + "}" * 100,
]


def test_against_the_plain_parser(spark):
    got = told(spark, CASES)
    for i, text in enumerate(CASES):
        assert got[i] == plain(text), text if text is None or len(text) < 200 else text[:80]


def test_mutated_answers_against_the_plain_parser(spark):
    """Good answers with characters dropped, doubled and swapped."""
    random.seed(7)
    good = [f'{{"identifiers": [{ITEM}, {ITEM.replace("a", "é", 1)}]}}', '{"identifiers": [{"exact_text": "x", "identifier_type": "y", "z": [1, {"q": null}]}], "more": {"a": [true, false]}}']
    texts = []
    for _ in range(1500):
        t = list(random.choice(good))
        for _ in range(random.randint(1, 3)):
            i = random.randrange(len(t))
            t[i : i + 1] = random.choice([[], [t[i]] * 2, [random.choice('{}[]",:1 n')], [*random.choice(['}]', ']}', '"a":1,', ',{}'])]])
        texts.append("".join(t))
    got = told(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == plain(text), text


@pytest.mark.parametrize("text", ['{"identifiers": [' + "9" * 1001 + "]}", '{"identifiers": ' + "[" * 1001 + "]" * 1001 + "}"])
def test_what_the_jvm_bounds(spark, text):
    """Longer numbers and deeper nesting than its parser takes are no usable answer, and no error."""
    assert told(spark, [text])[0] == (False, False, [])
