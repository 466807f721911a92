"""Declarative mappings: output path -> rule, turned into one ``select``.

A mapping is an ordered list of (path, rule). A path is a tuple of names, one per
level of nesting; a dot inside a name is literal. A rule is a Column, a SQL
expression, or one of the helpers below. Three results can be asked for:

* ``event(df)``: a typed struct; a value whose default has another type is null
  when absent;
* ``document(df)``: the event as JSON text with every default in place and null
  fields left out;
* ``flat(df)``: one column per leaf, those of mixed type as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping as Dict
from dataclasses import dataclass, field
from functools import reduce
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.schemas import NULL_KEYS, quoted

Literal = Union[str, int, float]
Path = tuple[str, ...]

JSON_OPTIONS = {"ignoreNullFields": "true"}


class Record:
    """The columns a rule may read, with the settings of this run."""

    def __init__(self, df: DataFrame, now: float | None = None):
        self.types = {f.name: f.dataType.typeName() for f in df.schema.fields}
        # A literal, or else one instant for the whole query.
        self.now = (
            F.lit(float(now))
            if now is not None
            else F.unix_micros(F.current_timestamp()).cast("double") / 1000000
        )
        self.exact = NULL_KEYS in self.types

    def column(self, name: str) -> Column:
        return F.col(quoted(name))

    def explicit_null(self, name: str) -> Column:
        """True when the record itself said null, which no default replaces."""
        if not self.exact:
            return F.lit(False)
        return F.array_contains(F.col(NULL_KEYS), name)

    def default(self, name: str, fallback: Column, value: Column | None = None) -> Column:
        filled = F.coalesce(self.column(name) if value is None else value, fallback)
        return F.when(~self.explicit_null(name), filled) if self.exact else filled

    def same_type(self, name: str, fallback: Literal) -> bool:
        kind = self.types[name]
        if isinstance(fallback, str):
            return kind == "string"
        return kind in ("long", "integer", "double")


@dataclass(frozen=True)
class Value:
    """A leaf bound to a DataFrame: its typed value, if it is of mixed type the
    stand-in for an absent one, whether it is null in every record, and whether
    its text is a number, in which nothing needs escaping."""

    typed: Column
    stand_in: Column | None = None
    never: bool = False
    digits: bool = False

    def text(self) -> Column:
        if self.stand_in is None:
            return self.typed
        return F.coalesce(self.typed.cast("string"), self.stand_in.cast("string"))

    def entries(self, name: str) -> list[Column]:
        """Struct entries to render: one, or two of which at most one is not null, or
        none for a field that never has a value."""
        if self.never:
            return []
        found = self.typed.alias(name)
        return [found] if self.stand_in is None else [found, self.stand_in.alias(name)]


Rule = Union[Column, str, Callable[[Record], Value]]


def take(name: str, default: Literal | None = None) -> Rule:
    """A source column, with a default for absent values."""

    def bind(rec: Record) -> Value:
        column = rec.column(name)
        if default is None:
            return Value(column)
        if rec.types[name] == "variant":
            return Value(rec.default(name, F.lit(default).cast("variant")))
        if rec.same_type(name, default):
            return Value(rec.default(name, F.lit(default).cast(rec.types[name])))
        missing = column.isNull() & ~rec.explicit_null(name)
        return Value(column, F.when(missing, F.lit(default)))

    return bind


def as_text(name: str, default: str) -> Rule:
    """A source column as text, for CEF extensions."""

    def bind(rec: Record) -> Value:
        text = rec.default(name, F.lit(default), rec.column(name).cast("string"))
        return Value(text, digits=rec.types[name] in ("long", "integer"))

    return bind


def constant(value: Literal) -> Rule:
    return lambda rec: Value(F.lit(value))


def omitted() -> Rule:
    """A field the target schema knows and no source fills."""
    return lambda rec: Value(F.lit(None).cast("string"), never=True)


def or_now(name: str) -> Rule:
    """A time column, the run's instant when absent (or when there is no such column)."""

    def bind(rec: Record) -> Value:
        return Value(rec.default(name, rec.now) if name in rec.types else rec.now)

    return bind


def total(*names: str) -> Rule:
    """Sum of counters that are 0 when absent; null when no bigint holds it."""
    return lambda rec: Value(reduce(F.try_add, (rec.default(n, F.lit(0)) for n in names)))


def computed(build: Callable[[Record], Column], digits: bool = False) -> Rule:
    """Any expression over the record; ``digits`` tells that it is a whole number."""
    return lambda rec: Value(build(rec), digits=digits)


def bind_rule(rule: Rule, record: Record) -> Value:
    if isinstance(rule, str):
        return Value(F.expr(rule))
    if isinstance(rule, Column):
        return Value(rule)
    return rule(record)


def _no_preparation(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Mapping:
    """An ordered set of (path, rule), with the columns it needs made first."""

    fields: tuple[tuple[Path, Rule], ...]
    prepare: Callable[[DataFrame], DataFrame] = field(default=_no_preparation)

    @staticmethod
    def of(
        fields: Iterable[tuple[str | Path, Rule]] | Dict[str, object],
        prepare: Callable[[DataFrame], DataFrame] = _no_preparation,
    ) -> Mapping:
        """From (path, rule) pairs, or from a dict with nested dicts."""
        if isinstance(fields, Dict):
            fields = _walk(fields, ())
        pairs = tuple(((p,) if isinstance(p, str) else tuple(p), rule) for p, rule in fields)
        return Mapping(pairs, prepare)

    def values(self, record: Record) -> list[tuple[Path, Value]]:
        return [(path, bind_rule(rule, record)) for path, rule in self.fields]

    def event(self, record: Record) -> Column:
        """The typed event struct."""
        return _struct([(p, [v.typed.alias(p[-1])]) for p, v in self.values(record)])

    def document(self, record: Record) -> Column:
        """The event as JSON text.

        A leaf of mixed type is given twice, as value and as stand-in; the null
        one of the two is left out, so its JSON type is right either way.
        """
        nested = _struct([(p, v.entries(p[-1])) for p, v in self.values(record)])
        return F.to_json(nested, JSON_OPTIONS)

    def flat(self, record: Record) -> list[Column]:
        """One column per leaf, named by its path joined with dots."""
        return [v.text().alias(".".join(p)) for p, v in self.values(record)]


def _walk(fields: Dict[str, object], above: Path) -> Iterable[tuple[Path, Rule]]:
    for name, rule in fields.items():
        if isinstance(rule, Dict):
            yield from _walk(rule, (*above, name))
        else:
            yield (*above, name), rule


def _struct(leaves: list[tuple[Path, list[Column]]], depth: int = 0) -> Column:
    """Nested struct from leaves; fields keep the order of first appearance."""
    grouped: dict[str, list[tuple[Path, list[Column]]]] = {}
    for path, columns in leaves:
        grouped.setdefault(path[depth], []).append((path, columns))
    parts: list[Column] = []
    for name, members in grouped.items():
        if len(members[0][0]) == depth + 1:
            parts += members[0][1]
        else:
            parts.append(_struct(members, depth + 1).alias(name))
    return F.struct(*parts)


def apply_mapping(
    df: DataFrame,
    mapping: Mapping,
    keep: Iterable[str] = (),
    output: str = "event",
    now: float | None = None,
) -> DataFrame:
    """Map every row; ``keep`` names source columns to carry along.

    ``output`` is ``event`` (typed struct), ``document`` (JSON text), both in a
    column ``event``, or ``flat`` (one column per leaf).
    """
    df = mapping.prepare(df)
    record = Record(df, now)
    kept = [F.col(quoted(name)) for name in keep]
    if output == "flat":
        leaves = df.select(*kept, *mapping.flat(record))
        loose = [f.name for f in leaves.schema if f.dataType.typeName() == "variant"]
        return leaves.withColumns({n: F.col(quoted(n)).cast("string") for n in loose})
    if output == "document":
        return df.select(*kept, mapping.document(record).alias("event"))
    if output == "event":
        return df.select(*kept, mapping.event(record).alias("event"))
    raise ValueError(f"unknown output {output!r}")
