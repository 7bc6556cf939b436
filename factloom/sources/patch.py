"""Unified diffs to file diffs: as DataFrame operations on lines, and as a table function."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.scalar import language
from ..lang.registry import language_of

HEADER = "diff --git "


class MalformedPatch(ValueError):
    pass


def header_paths(rest: str) -> tuple[str, str]:
    """The two paths after `diff --git `, quoted or not."""
    if rest.startswith('"'):
        end = rest.find('"', 1)
        if end < 0:
            raise MalformedPatch(rest)
        old, new = rest[1:end], rest[end + 1 :].lstrip().strip('"') if rest[end + 1 :].lstrip().startswith('"') else rest[end + 1 :].lstrip()
    elif " b/" in rest:
        old, _, new = rest.rpartition(" b/")
        new = "b/" + new
    else:
        old, space, new = rest.partition(" ")
        if not space:
            raise MalformedPatch(rest)
    return tuple(re.sub(r"^[ab]/", "", p) for p in (old, new))


def file_diffs(text: str):
    """(path, language, status, before, after) of each file of a patch; a header that can't be read fails."""
    files: list[list[str]] = []
    for line in re.split(r"\r?\n", text.removesuffix("\n")):
        if line.startswith(HEADER):
            files.append([line])
        elif files:
            files[-1].append(line)
    for header, *lines in files:
        old, new = header_paths(header[len(HEADER) :])
        status, i = "modified", 0
        for line in lines:
            word = next((s for p, s in META if line.startswith(p)), None)
            if word is None:
                break
            status, i = word or status, i + 1
        for mark in ("---", "+++"):
            if i < len(lines) and lines[i].startswith(mark):
                i += 1
        starts = [k for k in range(i, len(lines)) if lines[k].startswith("@@")]
        body = [x for x in lines[starts[0] :] if not x.startswith(("@@", "\\"))] if starts else []
        before = [x[1:] if x[:1] in ("-", " ") else x for x in body if not x.startswith("+")]
        after = [x[1:] if x[:1] in ("+", " ") else x for x in body if not x.startswith("-")]
        path = new if new != "/dev/null" else old
        yield path, language_of(path), status, "\n".join(before) if before and status != "added" else None, "\n".join(after) if after and status != "deleted" else None


#: Lines between a header and the hunks, and the status they set (empty: none).
META = (
    ("new file mode", "added"), ("deleted file mode", "deleted"), ("rename from", "renamed"), ("rename to", "renamed"), ("index ", ""), ("old mode", ""),
    ("new mode", ""), ("similarity", ""), ("dissimilarity", ""), ("copy from", ""), ("copy to", ""),
)


class ParsePatch:
    def eval(self, text: str):
        if text is not None:
            yield from file_diffs(text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("fl_parse_patch", udtf(ParsePatch, returnType="path string, language string, status string, before string, after string"))


def _starts(c: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(c, F.lit(p))
    return found


def _path(rest: Column) -> tuple[Column, Column]:
    quoted = F.startswith(rest, F.lit('"'))
    old = F.when(quoted, F.regexp_extract(rest, r'^"([^"]*)"', 1)).when(F.contains(rest, F.lit(" b/")), F.regexp_extract(rest, r"^(.*) b/", 1)).otherwise(F.regexp_extract(rest, r"^([^ ]*) ", 1))
    new = F.when(quoted, F.regexp_extract(rest, r'^"[^"]*"\s*"?([^"]*)', 1)).when(F.contains(rest, F.lit(" b/")), F.regexp_extract(rest, r"^.* (b/.*)\z", 1)).otherwise(F.regexp_extract(rest, r"^[^ ]* (.*)\z", 1))
    return F.regexp_replace(old, "^[ab]/", ""), F.regexp_replace(new, "^[ab]/", "")


def parse_patches(patches: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, path, language, status, before, after of all files of the patches; all on the JVM.

    Files are found by splitting a patch at its headers, so nothing is shuffled.
    """
    whole = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n", "\n"))
    chunks = F.slice(F.split(F.regexp_replace(whole, r"\n\z", ""), "\n" + HEADER), F.lit(2), F.greatest(F.lit(0), F.size(F.split(whole, "\n" + HEADER)) - 1))
    files = patches.select(key, F.posexplode(chunks).alias("file", "chunk")).withColumn("lines", F.split("chunk", "\n"))
    old, new = _path(F.element_at("lines", 1))
    rest = F.slice("lines", F.lit(2), F.greatest(F.lit(0), F.size("lines") - 1))
    files = files.withColumn("rest", rest).withColumn("path", F.when(new != "/dev/null", new).otherwise(old))
    meta = F.aggregate(
        "rest",
        F.struct(F.lit(True).alias("on"), F.lit("modified").alias("status")),
        lambda acc, x: F.struct(
            (acc["on"] & _starts(x, [p for p, _ in META])).alias("on"),
            F.when(~acc["on"], acc["status"]).when(_starts(x, ["new file mode"]), "added").when(_starts(x, ["deleted file mode"]), "deleted").when(_starts(x, ["rename from", "rename to"]), "renamed").otherwise(acc["status"]).alias("status"),
        ),
    )
    files = files.withColumn("status", meta["status"])
    first = F.array_position(F.transform("rest", lambda x: F.startswith(x, F.lit("@@"))), True).cast("int")
    body = F.when(first > 0, F.slice("rest", first, F.size("rest"))).otherwise(F.array().cast("array<string>"))
    files = files.withColumn("body", F.filter(body, lambda x: ~_starts(x, ["@@", "\\"])))

    def side(mark: str, other: str, none: str) -> Column:
        lines = F.transform(F.filter("body", lambda x: ~F.startswith(x, F.lit(other))), lambda x: F.when(_starts(x, [mark, " "]), F.substr(x, F.lit(2))).otherwise(x))
        return F.when((F.size(lines) > 0) & (F.col("status") != none), F.array_join(lines, "\n"))

    return files.select(key, "file", "path", language("path").alias("language"), "status", side("-", "+", "added").alias("before"), side("+", "-", "deleted").alias("after"))


def hunks(patches: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, path, hunk, old_start, old_end, new_start, new_end of every hunk: the lines it covers before and after.

    A side without lines has an end before its start. A hunk's header without a count covers one line.
    """
    lines = patches.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "line"))
    heads = lines.where(F.startswith("line", F.lit(HEADER)) | F.startswith("line", F.lit("@@")))
    old, new = _path(F.substr("line", F.lit(len(HEADER) + 1)))
    path = F.when(F.startswith("line", F.lit(HEADER)), F.when(new != "/dev/null", new).otherwise(old))
    above = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = heads.withColumn("path", F.last(path, ignorenulls=True).over(above)).where(F.startswith("line", F.lit("@@")) & F.col("path").isNotNull())
    part = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    number = lambda i: F.when(part(i) != "", part(i).cast("long"))
    ends = []
    for side, i in (("old", 1), ("new", 3)):
        ends += [number(i).alias(f"{side}_start"), (number(i) + F.coalesce(number(i + 1), F.lit(1)) - 1).alias(f"{side}_end")]
    placed = placed.where(part(1) != "")
    counted = placed.withColumn("hunk", F.row_number().over(Window.partitionBy(key, "path").orderBy("at")).cast("long"))
    return counted.select(key, "path", "hunk", *ends)


__all__ = ["MalformedPatch", "file_diffs", "header_paths", "hunks", "parse_patches", "register"]
