"""Basic regular expressions, as line filters take them, in the syntax Spark matches."""

from __future__ import annotations

# POSIX character classes, in the C locale.
CLASSES = {
    "alpha": "a-zA-Z",
    "digit": "0-9",
    "alnum": "a-zA-Z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "space": r"\x{9}-\x{d}\x{20}",
    "blank": r"\x{9}\x{20}",
    "punct": r"\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}",
    "print": r"\x{20}-\x{7e}",
    "graph": r"\x{21}-\x{7e}",
    "cntrl": r"\x{0}-\x{1f}\x{7f}",
    "xdigit": "0-9A-Fa-f",
}
_WORD = "[a-zA-Z0-9_]"
_START = f"(?<!{_WORD})(?={_WORD})"
_END = f"(?<={_WORD})(?!{_WORD})"
_EDGE = f"(?:{_START}|{_END})"
# What a backslash and a letter stand for.
_ESCAPES = {
    "w": _WORD,
    "W": "[^a-zA-Z0-9_]",
    "s": r"[\x{9}-\x{d}\x{20}]",
    "S": r"[^\x{9}-\x{d}\x{20}]",
    "<": _START,
    ">": _END,
    "b": _EDGE,
    "B": f"(?!{_EDGE})",
    "`": r"\A",
    "'": r"\z",
}
_EDGES = {_ESCAPES[x] for x in "<>bB`'"}
MOST_REPEATS = 32_767


def _literal(char: str) -> str:
    return char if char.isascii() and char.isalnum() else f"\\x{{{ord(char):x}}}"


def _bracket(text: str, at: int) -> tuple[str, int]:
    """The bracket expression that begins at ``at``, and where it ends."""
    negated = text[at + 1 : at + 2] == "^"
    at = first = at + 1 + negated
    parts: list[str] = []

    def element(at: int) -> tuple[str, int]:
        if text[at] == "[" and text[at + 1 : at + 2] in (".", "="):
            end = text.find(text[at + 1] + "]", at + 2)
            if end != at + 3:
                raise ValueError("a collating element is one character")
            return text[at + 2], end + 2
        return text[at], at + 1

    while at < len(text):
        if text[at] == "]" and at > first:
            return f"[{'^' * negated}{''.join(parts)}]", at + 1
        if text.startswith("[:", at):
            end = text.find(":]", at)
            if text[at + 2 : end] not in CLASSES or end < 0:
                raise ValueError(f"no character class at {at} of {text!r}")
            parts.append(CLASSES[text[at + 2 : end]])
            at = end + 2
            continue
        low, at = element(at)
        if text[at : at + 1] == "-" and text[at + 1 : at + 2] not in ("", "]"):
            high, at = element(at + 1)
            if high < low:
                raise ValueError(f"range {low}-{high} is in the wrong order")
            parts.append(f"{_literal(low)}-{_literal(high)}")
        else:
            parts.append(_literal(low))
    raise ValueError(f"a bracket is not closed in {text!r}")


def _interval(text: str, at: int) -> tuple[str, int]:
    """The repetition whose inside begins at ``at``, and where it ends."""
    end = text.find(r"\}", at)
    least, comma, most = text[at:end].partition(",")
    numbers = [n for n in (least, most) if n]
    if end < 0 or not (numbers or comma) or not all(n.isascii() and n.isdigit() for n in numbers):
        raise ValueError(f"no repetition at {at} of {text!r}")
    if max(map(int, numbers), default=0) > MOST_REPEATS or (least and most and int(least) > int(most)):
        raise ValueError(f"no such repetition as {least}{comma}{most}")
    return f"{{{int(least or 0)}{comma}{int(most) if most else ''}}}", end + 2


def basic_pattern(text: str) -> str:
    r"""A basic regular expression in the syntax of ``rlike``.

    Takes brackets with classes, anchors, ``*``, ``\{m,n\}``, ``\(`` groups ``\)`` and the
    common extensions ``\+ \? \| \w \s \b \<``. ``+ ? | ( ) {`` by themselves are plain
    characters, and so is a repetition with nothing before it. Classes are those of the C
    locale. An expression that is not well formed is a ValueError, and so are back
    references, repeated edges (``\b*``) and line feeds, which are not taken.
    """
    if "\n" in text:
        raise ValueError("a pattern is one line")
    out: list[list[str]] = [[]]  # atoms, by open group
    quantified = False
    at = 0

    def begins() -> bool:
        """Nothing here yet that could be repeated."""
        return not out[-1] or out[-1][-1] in ("|", "^")

    while at < len(text):
        char = text[at]
        escaped = char == "\\"
        if escaped:
            if at + 1 == len(text):
                raise ValueError("a pattern ends in a backslash")
            char = text[at + 1]
        at += 1 + escaped
        repeat = None
        repeats = char == "*" and not escaped or char in "+?{" and escaped
        if repeats and out[-1] and out[-1][-1] in _EDGES:
            raise ValueError("an edge of a word or line is not repeated")
        if not escaped and char == "[":
            atom, at = _bracket(text, at - 1)
        elif not escaped and char == ".":
            atom = "."
        elif not escaped and char == "^" and (not out[-1] or out[-1][-1] == "|"):
            atom = "^"
        elif not escaped and char == "$" and (at == len(text) or text.startswith((r"\)", r"\|"), at)):
            atom = r"\z"
        elif escaped and char == "(":
            out.append([])
            continue
        elif escaped and char == ")":
            if len(out) == 1:
                raise ValueError("a group ends that has not begun")
            atom = f"(?:{_joined(out.pop())})"
        elif escaped and char == "|":
            atom = "|"
        elif repeats and not begins():
            repeat, at = _interval(text, at) if char == "{" else (char, at)
        elif escaped and char.isdigit() and char != "0":
            raise ValueError("back references are not taken")
        elif escaped and char in _ESCAPES:
            atom = _ESCAPES[char]
        else:
            atom = _literal(char)
        if repeat is None:
            out[-1].append(atom)
        else:
            before = out[-1][-1]
            out[-1][-1] = (f"(?:{before})" if quantified or before[0] == "(" else before) + repeat
        quantified = repeat is not None
    if len(out) > 1:
        raise ValueError("a group is not closed")
    return f"(?s){_joined(out[0])}"


def _joined(atoms: list[str]) -> str:
    return "".join(r"\A" if atom == "^" else atom for atom in atoms)
