"""Scalar functions: colon-separated name lists, strings and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_list(names: Column) -> Column:
    return F.filter(F.split(names, ":"), lambda x: x != "")


def list_union(a: Column, b: Column) -> Column:
    return F.array_join(F.array_union(as_list(a), as_list(b)), ":")


def list_intersect(a: Column, b: Column) -> Column:
    return F.array_join(F.array_intersect(as_list(a), as_list(b)), ":")


def list_merge(a: Column, b: Column) -> Column:
    """All of ``a``, then those of ``b`` that ``a`` has not."""
    return F.array_join(F.concat(as_list(a), F.filter(as_list(b), lambda x: ~F.array_contains(as_list(a), x))), ":")


def list_append(a: Column, b: Column) -> Column:
    return F.array_join(F.concat(as_list(a), as_list(b)), ":")


def list_index(names: Column, name: Column) -> Column:
    """The name's place from 1, 0 if it is not there."""
    return F.array_position(as_list(names), name)


def list_count(names: Column) -> Column:
    return F.size(as_list(names))


def list_name(names: Column, k: int) -> Column:
    return F.get(as_list(names), k - 1)


def list_range(names: Column, first: int, last: int) -> Column:
    """The names from place ``first`` to ``last``."""
    return F.array_join(F.slice(as_list(names), first, max(0, last - first + 1)), ":")


def list_valid(names: Column) -> Column:
    """Whether the list is one: names without blanks between single colons."""
    return F.coalesce(names.rlike(r"^[^:\s]+(:[^:\s]+)*$"), F.lit(False))


def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def last_index(s: Column, part: str) -> Column:
    """The last place of ``part`` from 1, 0 if it is not there."""
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back > 0, F.length(s) - back - len(part) + 2).otherwise(0)


def between_tags(s: Column, start: str, end: str) -> Column:
    at = F.instr(s, start)
    rest = F.substring(s, at + len(start), F.length(s))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1)).otherwise("")


def cleaned(s: Column) -> Column:
    """Without blanks at its ends, and with any run of white space in it as one blank."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def template_date(template: Column, t: Column) -> Column:
    """The template with its marks filled in from a timestamp: %y4, %y2, %m1, %m2, %mc, %d1, %d2, %h1, %h2, %h3, %n2."""
    def number(c: Column) -> Column:
        return c.cast("string")

    def padded(c: Column, width: int) -> Column:
        return F.lpad(c.cast("string"), width, "0")

    # fixed values: the marks
    marks = {
        "%y4": padded(F.year(t), 4),
        "%y2": F.date_format(t, "yy"),
        "%m1": number(F.month(t)),
        "%m2": padded(F.month(t), 2),
        "%mc": F.lower(F.date_format(t, "MMM")),
        "%d1": number(F.day(t)),
        "%d2": padded(F.day(t), 2),
        "%h1": number(F.hour(t)),
        "%h2": padded(F.hour(t), 2),
        "%h3": padded(F.hour(t), 3),
        "%n2": padded(F.minute(t), 2),
    }
    out = template
    for mark, value in marks.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def alphanumeric(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def seconds_to_hms(s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def yyyymmdd_to_date(d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", F.floor(d / 10000), F.floor(F.pmod(d, F.lit(10000)) / 100), F.pmod(d, F.lit(100)))


def cf_time_unit(u: Column) -> tuple[Column, Column, Column]:
    """(unit, base date yyyymmdd, base seconds) of "days since 1990-01-01 00:00:00"."""
    unit = F.regexp_extract(u, r"^(\w+) since", 1)
    date = F.regexp_replace(F.regexp_extract(u, r"since (\d+-\d+-\d+)", 1), "-", "").cast("int")
    h, m, s = (F.coalesce(F.nullif(F.regexp_extract(u, r"(\d+):(\d+):(\d+)", k), F.lit("")), F.lit("0")).cast("int") for k in (1, 2, 3))
    return unit, date, h * 3600 + m * 60 + s
