"""Line patterns against the system's own line filter, on random patterns and lines."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from eventloom.functions.patterns import basic_pattern
from eventloom.operators.detect import established_line, established_match

PARTS = (
    "a b c 4 44 : . * + ? | ( ) { } ^ $ ] - / _ \\. \\* \\[ \\] \\^ \\$ \\/ \\( \\) \\| \\+ \\? "
    "\\{2\\} \\{1,2\\} \\{,2\\} \\{2,\\} \\{3,1\\} \\{x\\} [ab] [^a] []a] [^]a] [a-c] [c-a] [a-] [[:digit:]] "
    "[[:alpha:]_] [^[:space:]] [[.a.]] [.*] [a\\] \\w \\W \\s \\S \\b \\B \\< \\>"
).split()
LETTERS = "aabbc4:.*+?|(){}^$]-/_\\ [\t"


def system_answer(pattern, lines):
    """Numbers of the lines that match, or None for a pattern that is refused."""
    done = subprocess.run(
        ["grep", "-n", "-e", pattern], input="\n".join(lines) + "\n", text=True,
        capture_output=True, env={"LC_ALL": "C", "PATH": "/usr/bin:/bin"}, timeout=20,
    )
    if done.returncode == 2:
        return None
    return {int(row.split(":")[0]) - 1 for row in done.stdout.splitlines()}


@pytest.mark.skipif(shutil.which("grep") is None, reason="no line filter here")
def test_random_patterns_match_the_system(spark):
    rng = random.Random(11)
    lines = ["", "4444", "a:4444 ESTABLISHED", "aab", "a*b", "(a)", "a{2}"]
    lines += ["".join(rng.choices(LETTERS, k=rng.randint(1, 9))) for _ in range(60)]
    expected, columns = {}, {}
    for _ in range(600):
        pattern = "".join(rng.choices(PARTS, k=rng.randint(1, 5)))
        answer = system_answer(pattern, lines)
        try:
            columns[pattern] = basic_pattern(pattern)
        except ValueError as error:
            columns.pop(pattern, None)
            if "edge" in str(error):
                continue
            assert answer is None, pattern
            continue
        assert answer is not None, pattern
        expected[pattern] = answer
    assert len(expected) > 250
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1)
    names = list(expected)
    for start in range(0, len(names), 100):
        some = names[start : start + 100]
        hits = [F.col("line").rlike(columns[p]).alias(f"p{k}") for k, p in enumerate(some)]
        rows = frame.select("i", *hits).collect()
        for k, pattern in enumerate(some):
            assert {r.i for r in rows if r[f"p{k}"]} == expected[pattern], (pattern, columns[pattern])


def test_refused_patterns():
    for pattern in ("[a", "\\(a", "a\\)", "a\\", "a\\{3,1\\}", "[c-a]", "[[:no:]]", "\\(a\\)\\1", "a\nb"):
        with pytest.raises(ValueError):
            basic_pattern(pattern)


def test_established_match(spark):
    lines = ["tcp x:4444 ESTABLISHED", "tcp x:4544 ESTABLISHED", "tcp x:4444 LISTEN", None]
    frame = spark.createDataFrame([(x,) for x in lines], "event string")
    some = lambda c: [r.event for r in frame.filter(c).collect()]
    assert some(established_match("event", "4[45]44")) == lines[:2]
    assert some(established_match("event", "4.44$")) == []
    assert some(established_match("event", "4444")) == some(established_line("event", "4444")) == lines[:1]
