"""Option strings of the form ``set KEY value;set KEY2 value2;``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.scalars import SPACE_CLASS

_NOT_SPACE = SPACE_CLASS.replace("[", "[^;", 1)
# A part up to the next ``;``, stripped. Nothing is tried twice but the end of a value.
_SET_PART = (
    rf"(?is)(?:\A|;){SPACE_CLASS}*+set {SPACE_CLASS}*+({_NOT_SPACE}++){SPACE_CLASS}++"
    rf"({_NOT_SPACE}(?:[^;]*{_NOT_SPACE})?){SPACE_CLASS}*+(?=;|\z)"
)


def option_map(options: Column) -> Column:
    """Option string to ``map<string,string>``.

    Parts are split at ``;``; only parts starting with ``set `` (any case) that
    hold a key and a value count. The value keeps its inner blanks, and the last
    setting of a key wins.
    """
    keys, values = (F.regexp_extract_all(options, F.lit(_SET_PART), F.lit(i)) for i in (1, 2))
    # Bound as a variable, they are found once and not again for every setting.
    back = F.array(F.struct(F.reverse(keys).alias("keys"), F.reverse(values).alias("values")))

    def last(found: Column) -> Column:
        names = F.array_distinct(found["keys"])
        said = F.transform(
            names, lambda k: F.get(found["values"], F.array_position(found["keys"], k) - 1)
        )
        return F.map_from_arrays(F.reverse(names), F.reverse(said))

    return F.transform(back, last)[0]
