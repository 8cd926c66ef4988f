"""Header names and comma-separated name lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns that hold comma-separated person names.
NAME_FIELDS = ("producers", "directors", "writers", "actors")

EMBEDDING_SUFFIX = "Embedding"

# Whitespace as Python's str.strip sees it: the Unicode class plus the four ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def camel_case(name: str) -> str:
    """camelCase form of a header: split at blanks and underscores, later words capitalised."""
    words = re.findall(r"[^ _]+", name)
    if not words:
        return name.lower()
    head, *tail = words
    return "".join([head.lower(), *map(str.capitalize, tail)])


def camel_case_col(c: Column) -> Column:
    """`camel_case` over a column of headers."""
    words = F.filter(F.split(c, "[ _]"), lambda w: w != "")
    tail = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))),
    )
    return F.when(F.size(words) == 0, F.lower(c)).otherwise(
        F.concat(F.lower(F.try_element_at(words, F.lit(1))), F.array_join(tail, ""))
    )


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (Spark's trim removes spaces only)."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def dedupe_names(c: Column) -> Column:
    """Trim the names of a comma-separated list, drop empty and repeated ones, keep first-seen order."""
    names = F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda n: n != ""))
    return F.when(strip(c) == "", c).otherwise(F.array_join(names, ", "))


def is_name_field(header: str, name_fields: Sequence[str] = NAME_FIELDS) -> bool:
    return camel_case(header) in name_fields


def embedding_name(field: str) -> str:
    return field + EMBEDDING_SUFFIX


def source_name(field: str) -> str:
    return field.removesuffix(EMBEDDING_SUFFIX)
