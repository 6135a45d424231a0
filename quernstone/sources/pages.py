"""Transcripts with markers, tables in markdown, data embedded in scripts, and drawing commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import same_keys


def blocks(files: DataFrame, name: str, text: str) -> DataFrame:
    """Blocks of transcript pages in order: doc, seq, kind and payload. Blank lines part paragraphs; markers stand alone."""
    parts = files.select(
        name,
        F.posexplode(
            F.split(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"(?m)^(\[\[[A-Z]+[^\]]*\]\].*)$", "\n\n$1\n\n"), r"\n\s*\n")
        ).alias("seq", "raw"),
    ).withColumn("raw", F.trim(F.translate("raw", "\n", " "))).where("raw <> ''")
    marker = F.lower(F.regexp_extract("raw", r"^\[\[([A-Z]+)", 1))
    payload = F.when(marker == "", F.col("raw")).otherwise(
        F.trim(
            F.concat_ws(
                " ",
                F.regexp_extract("raw", r"^\[\[[A-Z]+\s*([^\]]*)\]\]", 1),
                F.regexp_extract("raw", r"^\[\[[^\]]*\]\]\s*(.*)$", 1),
            )
        )
    )
    return parts.select(name, "seq", F.when(marker == "", "p").otherwise(marker).alias("kind"), payload.alias("payload"))


#: Fixed values of the format: the side to move, the number of the move, and the mark before a solution.
SIDES = {"белых": "w", "чёрных": "b"}
TO_MOVE, OF_MOVE, SOLUTION = "Ход", "ход", "Решение."


def numbered_problems(text: Column) -> Column:
    """Problems (n, title, side, move, position, solution) of a text of sections like `## 12. Title`.

    A section tells the side and the move in bold, the position between fences, and the solution after its mark to the
    section's end, in one line. Sections that lack one of the first three are left out; without a solution it is empty.
    """
    sections = F.split(F.translate(text, "\r", ""), r"(?m)^(?=## \d+\. )")
    taken = lambda x, pattern, i=1: F.regexp_extract(x, pattern, i)
    names = F.create_map(*(F.lit(v) for pair in SIDES.items() for v in pair))
    told = rf"\*\*{TO_MOVE} ({'|'.join(SIDES)})\*\*\s*·\s*{OF_MOVE} (\d+)"
    after = lambda x: F.when(F.contains(x, F.lit(SOLUTION)), F.substring_index(x, SOLUTION, -1)).otherwise("")
    read = F.transform(
        sections,
        lambda x: F.struct(
            taken(x, r"^## (\d+)\. ").try_cast("int").alias("n"),
            F.trim(taken(x, r"^## \d+\. (.*)")).alias("title"),
            F.try_element_at(names, taken(x, told)).alias("side"),
            taken(x, told, 2).try_cast("int").alias("move"),
            F.trim(taken(x, r"(?m)^```\n([^\n]+)\n```$")).alias("position"),
            F.trim(F.regexp_replace(F.replace(after(x), F.lit("*"), F.lit("")), r"\s+", " ")).alias("solution"),
        ),
    )
    return F.filter(read, lambda x: x["n"].isNotNull() & x["side"].isNotNull() & (x["position"] != ""))


def table_rows(text: Column) -> Column:
    """The rows of a markdown table, cells trimmed; the heading's rule line is left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda cell: F.trim(cell)))


def rows_in_pieces(files: DataFrame, name: list[str], piece: str, text: str) -> DataFrame:
    """name, n (from 0 on over the whole file) and cells of the table's rows in files that come in pieces of whole lines.

    Only a count for each piece goes over a whole file.
    """
    read = files.select(*name, F.col(piece).alias("__piece"), table_rows(F.col(text)).alias("__rows"))
    counts = read.select(*name, "__piece", F.size("__rows").alias("__size"))
    before = F.sum("__size").over(W.partitionBy(*name).orderBy("__piece")) - F.col("__size")
    starts = counts.select(*name, "__piece", before.alias("__start"))
    placed = read.alias("r").join(starts.alias("s").hint("merge"), same_keys("r", "s", [*name, "__piece"]))
    held = placed.select(*(F.col(f"r.{c}").alias(c) for c in name), "__start", F.posexplode("__rows").alias("__at", "cells"))
    return held.select(*name, (F.col("__start") + F.col("__at")).cast("int").alias("n"), "cells")


def embedded_json(script: Column) -> Column:
    """The object that a script assigns: from its first brace to its last."""
    return F.regexp_extract(script, r"(?s)^[^{]*(\{.*\})", 1)


def fields(text: Column, pattern: str, names: list[str]) -> Column:
    """Every match of a pattern as a struct of its groups."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*groups)


def fingerprints(shapes: DataFrame, cell: list[str], values: list[str]) -> DataFrame:
    """The drawing commands of each cell in one order, as JSON: equal cells have equal prints."""
    return shapes.groupBy(*cell).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*values)))).alias("print"))


def visible_to(rows: DataFrame, user: str, owner: str, public: Column) -> DataFrame:
    """The rows that a user may see: their own and public ones. A view by convention; nothing enforces it."""
    return rows.where((F.col(owner) == user) | public)


def by_prefix(rows: DataFrame, key: str, prefix: str, not_prefix: str, most: int = 1000) -> DataFrame:
    """The first keys that begin with one text and not with another."""
    return rows.where(F.startswith(key, F.lit(prefix)) & ~F.startswith(key, F.lit(not_prefix))).orderBy(key).limit(most)
