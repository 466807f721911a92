"""Shell words and command decomposition."""

from __future__ import annotations

import posixpath
import random
import shlex

import pytest

from eventloom.functions import with_command, with_shell_words


def words(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.w for r in with_shell_words(df, "t", "w").orderBy("i").collect()]


def command(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return with_command(df, "t", **kw).first()


def test_random_texts_against_shlex(spark):
    rng = random.Random(3)
    atoms = ["a", "bc", " ", "  ", "\t", "\n", "'", '"', "\\", "#", "é", "$x", "=", "\x0b", "/", "-f"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, got in zip(texts, words(spark, texts)):
        try:
            want = shlex.split(text)
        except ValueError:
            want = None
        assert got == want, repr(text)


def test_long_text_with_quotes(spark):
    text = "sh -c " + "'a b' \"c\\\"d\" " * 20000
    assert words(spark, [text])[0] == shlex.split(text)


def test_plain_command(spark):
    got = command(spark, "/usr/bin/python3 script.py arg1")
    assert (got.cmd_filename, got.cmd_path, got.cmd_abspath) == ("python3", "/usr/bin", "/usr/bin/python3")
    assert got.cmd_args == ["script.py"]
    assert got.cmd_fullcmd == "/usr/bin/python3 script.py arg1"
    assert got.cmd_ok


@pytest.mark.parametrize(
    "text, abspath, name, full",
    [
        ("/usr/libexec/rosetta /usr/bin/python3 script.py", "/usr/bin/python3", "python3", "script.py"),
        ("/usr/bin/qemu-i386 /usr/local/bin/app --flag", "/usr/local/bin/app", "app", "--flag"),
        ("rosetta rel/app", "rel/app", "app", ""),
        ("sh -c 'a b'", "/sh", "sh", "sh -c a b"),
        ("[kthreadd]", "/[kthreadd]", "[kthreadd]", "[kthreadd]"),
    ],
)
def test_command_parts(spark, text, abspath, name, full):
    got = command(spark, text)
    assert (got.cmd_abspath, got.cmd_filename, got.cmd_fullcmd, got.cmd_ok) == (abspath, name, full, True)


@pytest.mark.parametrize("text", ["it's", "", "   ", None, "rosetta"])
def test_unusable_commands(spark, text):
    got = command(spark, text)
    assert got.cmd_ok is False
    assert (got.cmd_abspath, got.cmd_filename, got.cmd_path, got.cmd_args, got.cmd_fullcmd) == (None,) * 5


def test_paths_against_posixpath(spark):
    rng = random.Random(5)
    atoms = ["a", "b.c", ".", "..", "...", "/", "//", "/x"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for text, got in zip(texts, with_command(df, "t", cwd="/srv/run").orderBy("i").collect()):
        want = posixpath.normpath(posixpath.join("/srv/run", text))
        assert got.cmd_abspath == want, text
        assert got.cmd_filename == posixpath.basename(want), text
        assert got.cmd_path == posixpath.dirname(want), text
