"""Dates from names and paths, file names, page ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: newspaper id, date, running number, issue, H, issue of the day, page.
ALTO_NAME = r"^([A-Z0-9]+)_(\d{4})-(\d{2})-(\d{2})_\d{3}_(\d+)_H_(\d+)_(\d+)"
PAGE_NAME = r"(\d{4}-\d{2}-\d{2})_\d+_(\d+)_H_(\d+)_(\d+)"


def part(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, null where it doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def alto_name(filename: Column) -> Column:
    """newspaper_id, date (null if impossible), issue_number, daily_issue_number, page_number; nulls for other names."""
    group = lambda i: part(filename, ALTO_NAME, i)
    date = F.try_to_timestamp(F.concat_ws("-", group(2), group(3), group(4)), F.lit("yyyy-MM-dd"))
    return F.struct(
        group(1).alias("newspaper_id"), F.when(filename.rlike(ALTO_NAME), date).alias("date"), group(5).try_cast("int").alias("issue_number"),
        group(6).try_cast("int").alias("daily_issue_number"), group(7).try_cast("int").alias("page_number"),
    )


def page_id(filename: Column, date: Column, issue: Column, daily: Column, page: Column) -> Column:
    """YYYY-MM-DD_iii_H_d_ppp, or the file's stem where any of them is missing or 0."""
    whole = date.isNotNull() & (issue > 0) & (daily > 0) & (page > 0)
    made = F.format_string("%s_%03d_H_%d_%03d", F.date_format(date, "yyyy-MM-dd"), issue, daily, page)
    return F.when(F.coalesce(whole, F.lit(False)), made).otherwise(stem(filename))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]+$", "")


def date_in(c: Column) -> Column:
    """The first date in an id, as text; null if there is none."""
    return part(c, r"(\d{4}-\d{2}-\d{2})", 1)


def year_in(c: Column) -> Column:
    return part(c, r"(\d{4})-\d{2}-\d{2}", 1).try_cast("int")


def month_in(c: Column) -> Column:
    return part(c, r"\d{4}-(\d{2})-\d{2}", 1).try_cast("int")


def day_in(c: Column) -> Column:
    return part(c, r"\d{4}-\d{2}-(\d{2})", 1).try_cast("int")


def basename_date(c: Column) -> Column:
    """Date in the second part of a name joined by underscores; null if it is none."""
    return F.try_to_date(F.get(F.split(c, "_"), F.lit(1)), "yyyy-MM-dd")


def path_date(c: Column) -> Column:
    """YYYY-MM-DD of a path that begins YYYY/MM/DD/."""
    return F.concat_ws("-", F.slice(F.split(c, "/"), 1, 3))


def fulltext_issue(path: Column) -> Column:
    """year, month, day, issue, uid of .../YYYY/MM/DD/II/fulltext[/...]; null for other paths."""
    pattern = r"(?:^|/)(\d{4})/(\d{2})/(\d{2})/([^/]+)/fulltext(?:/|$)"
    names = ("year", "month", "day", "issue")
    parts = [F.regexp_extract(path, pattern, i + 1) for i in range(4)]
    uid = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit("-i"), parts[3])
    return F.when(path.rlike(pattern), F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True)), uid.alias("uid")))


def mets_path(alto_path: Column) -> Column:
    """Path of the issue's metadata file for .../fulltext/<id>_<ddd>.xml; null for other paths."""
    pattern = r"^(.*)/fulltext/([^/]+?)_\d{3}\.xml$"
    return F.when(alto_path.rlike(pattern), F.regexp_replace(alto_path, pattern, "$1/$2.xml"))


def from_parts(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd")


def tolerant_double(c: Column) -> Column:
    """Number with point or comma; 0 for null, blank and junk."""
    return F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits count as numbers of up to 12 digits."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")
