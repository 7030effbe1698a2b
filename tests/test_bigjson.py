"""A large JSON object cut into entries by blocks of any size, against the whole-text parse."""

import json
import random

import numpy as np
import pytest

from cadenza.sources import bigjson, corpora


def odd_object(seed, n=300):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice(['"', "\\", ",", "{", "}", "[", "]", "é", "漢", " ", "\n", "a", ":", "\\\\", '\\"']) for _ in range(rnd.randint(0, 12)))
    value = lambda d: rnd.choice([text(), rnd.random(), None, [], {}, True]) if d > 2 else rnd.choice([text(), [value(d + 1) for _ in range(rnd.randint(0, 3))], {text(): value(d + 1) for _ in range(rnd.randint(0, 3))}])
    return {f"{text()}{i}": value(0) for i in range(n)}


def by_hand(data, state):
    """The scanner byte by byte."""
    out, depth, moved = [], 0, []
    for c in data:
        quoted = state != bigjson.OUT
        if state == bigjson.ESCAPED:
            state = bigjson.IN
        elif state == bigjson.IN:
            state = bigjson.OUT if c == 34 else bigjson.ESCAPED if c == 92 else bigjson.IN
        elif c == 34:
            state = bigjson.IN
        else:
            depth += (c in b"{[") - (c in b"}]")
        out.append(not quoted and c != 34)
        moved.append(depth)
    return state, out, moved


def test_scan_equals_a_byte_by_byte_scanner():
    rnd = random.Random(1)
    for _ in range(3000):
        state = rnd.randrange(3)
        data = bytes(rnd.choice(b'"\\\\,{}[]a') for _ in range(rnd.randint(0, 14)))
        if state == bigjson.OUT and b"\\" in data.split(b'"')[0]:
            continue  # a backslash outside strings isn't JSON
        after, outside, moved = bigjson.scan(np.frombuffer(data, np.uint8), state)
        want = by_hand(data, state)
        # what stands outside a string after a backslash there isn't JSON either
        if any(data[i] == 92 for i, o in enumerate(want[1]) if o):
            continue
        assert (after, outside.tolist(), moved.tolist()) == want, (data, state)


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_entries_equal_the_whole_parse(spark, tmp_path, block):
    objects = [odd_object(s) for s in range(3)] + [{}, {"": {"x": ",}"}}, {"long": ["y" * 5000, '\\",\\"' * 300], "z": 1}]
    for i, o in enumerate(objects):
        (tmp_path / f"{i}.json").write_text(json.dumps(o, ensure_ascii=bool(i % 2), indent=2 if i == 1 else None) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = bigjson.json_entries(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert block > 1000 or len({r["block"] for r in rows}) > 20
    for i, o in enumerate(objects):
        mine = sorted((r["block"], r["seq"], r["value"]) for r in rows if r["path"].endswith(f"/{i}.json"))
        entries = [json.loads(v) for _, _, v in mine]
        assert all(len(e) == 1 for e in entries)
        assert [k for e in entries for k in e] == list(o) and {k: v for e in entries for k, v in e.items()} == o


def test_the_last_of_equal_keys_counts(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"u": {"text": "a, b"}, "v": {"text": "x", "words": [{"text": "}"}]}, "u": {"text": "c"}}')
    got = {r["utterance_id"]: r["entry"]["text"] for r in corpora.score_object(spark, str(tmp_path)).collect()}
    assert got == {"u": "c", "v": "x"}
