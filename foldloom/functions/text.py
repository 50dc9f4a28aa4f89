"""Expressions over ids, paths and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the two classes.
LABEL_NAMES = {0: "nonseizure", 1: "seizure"}

_BLANK = r"[\x1c-\x1f\p{IsWhite_Space}]"
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
           + "\u2028\u2029\u202f\u205f\u3000")


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def natural_key(value: str | Column) -> Column:
    """A string whose plain order is the natural order of ``value``: ``c2 < c10 < c17 < c17a``.

    Digit runs compare as whole numbers of any length and sort before text. A plain string key keeps
    sorting and range partitioning on Spark's fast path.
    """
    runs = F.regexp_extract_all(as_column(value), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 9, "0"), digits)
        # NUL is doubled with a larger mark inside text, so the end mark stays the smallest suffix.
        text = F.concat(F.lit("1"), F.replace(run, F.lit("\0"), F.lit("\0\x02")), F.lit("\0\x01"))
        return F.when(run.rlike("^[0-9]"), number).otherwise(text)

    return F.array_join(F.transform(runs, encode), "")


def path_parts(path: str | Column) -> Column:
    """Path components, with backslashes read as slashes."""
    return F.split(F.replace(as_column(path), F.lit("\\"), F.lit("/")), "/", -1)


def path_class(path: str | Column) -> Column:
    """Class folder of a three-part record path, else NULL."""
    parts = path_parts(path)
    return F.when(F.size(parts) == 3, parts[0])


def path_case(path: str | Column) -> Column:
    """Case folder of a three-part record path, else NULL."""
    parts = path_parts(path)
    return F.when(F.size(parts) == 3, parts[1])


def label_name(label: str | Column, names: dict[int, str] = LABEL_NAMES) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_column(label).cast("int"))


def is_blank(value: str | Column) -> Column:
    text = as_column(value).cast("string")
    return text.isNull() | text.rlike(f"^{_BLANK}*$")


def normalize_hash(value: str | Column) -> Column:
    return F.lower(as_column(value))


def coerce_index(value: str | Column) -> Column:
    return as_column(value).try_cast("bigint")


def content_sha256(value: str | Column) -> Column:
    return F.sha2(as_column(value), 256)


def normalized_content(value: str | Column) -> Column:
    """Text without the differences that do not count: line ends, trailing blanks, blank and ``#`` lines."""
    text = F.replace(F.replace(as_column(value), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit(_BLANKS)))
    kept = F.filter(lines, lambda x: (x != "") & ~F.ltrim(x, F.lit(_BLANKS)).startswith("#"))
    return F.array_join(kept, "\n")


def normalized_content_sha256(value: str | Column) -> Column:
    return F.sha2(normalized_content(value), 256)


def record_line(*columns: str | Column) -> Column:
    """Tab-joined values; NULL becomes an empty field instead of vanishing."""
    return F.concat_ws("\t", *[F.coalesce(as_column(c).cast("string"), F.lit("")) for c in columns])


def task_id(groups: str | Column) -> Column:
    """``[[Z, O], [S]]`` becomes ``Z+O_vs_S``."""
    return F.array_join(F.transform(as_column(groups), lambda g: F.array_join(g, "+")), "_vs_")


def task_sets(groups: str | Column) -> Column:
    """Number of sets over all groups of a task."""
    return F.size(F.flatten(as_column(groups)))


def joined_list(items: str | Column, separator: str = ";") -> Column:
    return F.array_join(as_column(items), separator)
