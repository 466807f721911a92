"""Process command lines: shell word split and decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The POSIX shell quoting rules as patterns.
BLANKS = " \t\r\n"
BALANCED = r"""(?s)^(?:[^'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+")*+\z"""
WORD = r"""(?s)(?:[^ \t\r\n'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+")++"""
PIECE = r"""(?s)'[^']*+'|"(?:[^"\\]++|\\.)*+"|\\.|[^'"\\]++"""
QUOTING = r"""['"\\]"""

# Emulators that stand before the real executable.
EMULATORS = ("rosetta", "qemu-i386")


def _empty() -> Column:
    return F.array().cast("array<string>")


def _unquote(piece: Column) -> Column:
    inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
    return (
        F.when(piece.startswith("'"), inner)
        .when(piece.startswith('"'), F.regexp_replace(inner, r'(?s)\\(["\\])', "$1"))
        .when(piece.startswith("\\"), F.substr(piece, F.lit(2)))
        .otherwise(piece)
    )


def _words(text: Column) -> Column:
    """Shell words of a text; null when a quote or a backslash is left open."""
    trimmed = F.trim(text, F.lit(BLANKS))
    plain = F.when(trimmed == "", _empty()).otherwise(F.split(trimmed, "[ \t\r\n]+"))
    quoted = F.transform(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda word: F.array_join(
            F.transform(F.regexp_extract_all(word, F.lit(PIECE), F.lit(0)), _unquote), ""
        ),
    )
    return F.when(~text.rlike(QUOTING), plain).when(text.rlike(BALANCED), quoted)


def with_shell_words(df: DataFrame, source: Column | str, name: str) -> DataFrame:
    """Add the shell words of a text column as ``array<string>``.

    Quotes and backslashes follow the POSIX shell; there are no comments. Text
    with an open quote gives null. Text without any quoting, the usual case, is
    split at its blanks only.
    """
    text = F.col(source) if isinstance(source, str) else source
    return df.withColumn(name, _words(text))


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _directory(path: Column) -> Column:
    head = F.substr(path, F.lit(1), F.length(path) - F.length(_file_name(path)))
    return F.when(head.rlike(r"^/*\z"), head).otherwise(F.rtrim(head, F.lit("/")))


def _normal_path(path: Column) -> Column:
    """Normalise a rooted path: no empty, ``.`` or ``..`` segments."""
    parts = F.aggregate(
        F.split(path, "/"),
        _empty(),
        lambda seen, part: F.when(part.isin("", "."), seen)
        .when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.array_append(seen, part)),
    )
    # Exactly two leading slashes stay two.
    root = F.when(path.rlike("^//(?!/)"), "//").otherwise("/")
    untidy = path.rlike(r"/\.{0,2}(?:/|\z)")
    return F.when(untidy, F.concat(root, F.array_join(parts, "/"))).otherwise(path)


def with_command(
    df: DataFrame, source: Column | str, prefix: str = "cmd", cwd: str = "/"
) -> DataFrame:
    """Add the parts of a command line.

    Adds ``<prefix>_path``, ``_filename``, ``_abspath`` (string), ``_args``
    (array without the executable and without the last argument), ``_fullcmd``
    (the words joined by one blank) and ``_ok``. An emulator in front is left
    out, and then ``_fullcmd`` starts after the executable. A missing or
    unbalanced command gives nulls and ``_ok`` false.
    """
    words, rest = f"__{prefix}_words", f"__{prefix}_rest"
    first, rooted = f"__{prefix}_first", f"__{prefix}_rooted"
    ok = F.col(f"{prefix}_ok")

    df = with_shell_words(df, source, words)
    df = df.withColumn(first, F.try_element_at(F.col(words), F.lit(1)))
    emulated = _file_name(F.col(first)).isin(*EMULATORS)
    count = F.size(F.col(words))
    df = df.withColumns(
        {
            f"{prefix}_ok": F.coalesce(
                F.col(first).isNotNull() & (~emulated | (count > 1)), F.lit(False)
            ),
            rest: F.when(emulated, F.slice(F.col(words), F.lit(3), F.greatest(count - 2, F.lit(0)))).otherwise(
                F.col(words)
            ),
            rooted: F.when(
                ~emulated,
                F.when(F.col(first).startswith("/"), F.col(first)).otherwise(
                    F.concat(F.lit(cwd.rstrip("/") + "/"), F.col(first))
                ),
            ),
        }
    )
    df = df.withColumn(
        f"{prefix}_abspath",
        F.when(
            ok,
            F.when(F.col(rooted).isNull(), F.try_element_at(F.col(words), F.lit(2))).otherwise(
                _normal_path(F.col(rooted))
            ),
        ),
    )
    abspath = F.col(f"{prefix}_abspath")
    df = df.withColumns(
        {
            f"{prefix}_filename": _file_name(abspath),
            f"{prefix}_path": _directory(abspath),
            f"{prefix}_args": F.when(
                ok,
                F.slice(F.col(rest), F.lit(2), F.greatest(F.size(F.col(rest)) - 2, F.lit(0))),
            ),
            f"{prefix}_fullcmd": F.when(ok, F.array_join(F.col(rest), " ")),
        }
    )
    return df.drop(words, rest, first, rooted)
