from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from evenkeel.operators.linediff import edit_script, ordered_diff


def slow_kept(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def check(a, b):
    script = edit_script(a, b)
    assert [x for x, _ in script if x is not None] == list(range(len(a)))
    assert [y for _, y in script if y is not None] == list(range(len(b)))
    kept = [(x, y) for x, y in script if None not in (x, y)]
    assert all(a[x] == b[y] for x, y in kept)
    return kept


def test_as_many_lines_as_possible_are_kept():
    rng = random.Random(5)
    for _ in range(600):
        letters = "abcdefghij"[: rng.randint(1, 10)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert len(check(a, b)) == slow_kept(a, b)


def test_long_texts_and_one_very_common_line():
    rng = random.Random(6)
    a = [rng.choice(["", "", f"step {i}"]) for i in range(6000)]
    b = [line for line in a if rng.random() > 0.2]
    rng.shuffle(moved := b[:100])
    started = time.time()
    assert len(check(a, b)) == len(b)
    assert len(check(a, b[100:] + moved)) >= len(b) - 100
    assert time.time() - started < 60


def listing(spark, source, target, keys=("id",)):
    kind = "id bigint, definition string, line string"
    left, right = (spark.createDataFrame([(*r, "clash") for r in side], kind) for side in (source, target))
    return [tuple(r) for r in ordered_diff(left, right, list(keys)).orderBy("id", "position").collect()]


def test_a_moved_line_is_deleted_and_inserted(spark):
    assert listing(spark, [(1, "tide\nwind\nsail")], [(1, "wind\r\nsail\rtide")]) == [
        (1, 0, 0, None, "tide", "deleted"),
        (1, 1, 1, 0, "wind", "unchanged"),
        (1, 2, 2, 1, "sail", "unchanged"),
        (1, 3, None, 2, "tide", "inserted"),
    ]


def test_nulls_empty_texts_and_missing_rows(spark):
    source = [(None, "a\nb"), (2, None), (3, ""), (4, "only here")]
    target = [(None, "b"), (2, "new"), (3, ""), (5, "only there\n")]
    assert listing(spark, source, target) == [
        (None, 0, 0, None, "a", "deleted"),
        (None, 1, 1, 0, "b", "unchanged"),
        (2, 0, None, 0, "new", "inserted"),
        (3, 0, 0, 0, "", "unchanged"),
        (4, 0, 0, None, "only here", "deleted"),
        (5, 0, None, 0, "only there", "inserted"),
        (5, 1, None, 1, "", "inserted"),
    ]
    assert listing(spark, [], []) == []
    assert ordered_diff(spark.range(0).select("id", F.lit("x").alias("definition")), spark.range(1).select("id", F.lit("x").alias("definition")), ["id"]).count() == 1
