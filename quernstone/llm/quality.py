"""Quality rules: statistics of each text and a learned decision list over them, all as Spark expressions.

The list is learned by sequential covering. From labelled statistics a rule grows: threshold conditions
are added one by one while they shed good documents, then conditions are pruned from its end on rows held
out, and the rule is taken if it is precise enough there; the rows it covers are put away and the next
rule is learned from the rest. The list becomes one ordered conditional expression, so judging a
corpus is a scan without shuffles or Python.

Labels: at most `sample` labelled documents (20,000) are used, those with the least hash of their id; that bound
is the one thing here that does not grow with the corpus. A list has at most 12 rules of at most 4 conditions, whose
thresholds are at most 64 quantiles of a statistic over the bad rows that are left; a third of the rows is held
out, and a rule needs a precision of 0.9 there. Statistics and verdicts cover all documents.

Cases: a null text has no words and fails the base rule; without labels, or with labels of one class,
the list is empty and keeps what passes the base rule; labels that are null are ignored, of several for
one document the lowest counts; rows with equal ids each get a row; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, documents

SAMPLE = 20_000
MOST_THRESHOLDS, MOST_CONDITIONS, MOST_RULES, PRECISION = 64, 4, 12, 0.9
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules may ask about: whole numbers, shares in thousandths.
FEATURES = {
    "n_words": "n_words",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "capitals": "1000 * n_capitals div greatest(word_chars, 1)",
    "marks": "1000 * n_marks div greatest(n_words, 1)",
    "line_words": "n_words div greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The columns `keys`, the base statistics and the further counts that the features need, of every whole text."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = rows.select(
        *keys,
        F.array_remove(F.split("t", BLANK), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
    )
    last = F.size("words") - WINDOW
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    counted = split.select(
        *keys,
        "n_symbols",
        "n_capitals",
        "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Only texts in which some window comes twice go on to find out where.
    some_twice = F.size(F.array_distinct("windows")) < F.size("windows")
    suspected = counted.withColumn("windows", F.when(some_twice, F.col("windows")).otherwise(F.array().cast("array<bigint>")))
    in_order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = suspected.withColumn("placed", in_order).drop("windows")
    same = lambda p, i: (p["h"] == F.get("placed", i - 1)["h"]) | (p["h"] == F.get("placed", i + 1)["h"])
    repeated = F.transform("placed", lambda p, i: F.when(F.coalesce(same(p, i), F.lit(False)), p["i"]))
    starts = placed.withColumn("starts", F.array_sort(F.filter(repeated, lambda x: x.isNotNull())))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    add = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last"))
    in_windows = F.aggregate("starts", nothing, add, lambda acc: acc["n"]).alias("n_repeat_words")
    return starts.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", in_windows, "n_lines", "n_capitals", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def holds(self, row: dict[str, int]) -> bool:
        return (row[self.feature] >= self.threshold) if self.above else (row[self.feature] <= self.threshold)

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, row: dict[str, int]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def thresholds(values: list[int], most: int = MOST_THRESHOLDS) -> list[int]:
    """Cuts between the values' quantiles."""
    distinct = sorted(set(values))
    return distinct if len(distinct) <= most else sorted({distinct[i * (len(distinct) - 1) // (most - 1)] for i in range(most)})


def grow(bad: list[dict[str, int]], good: list[dict[str, int]], most: int = MOST_CONDITIONS) -> Rule:
    """Adds the condition of the highest information gain until no good row is covered or nothing is gained."""
    chosen: tuple[Condition, ...] = ()
    while good and len(chosen) < most:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, gained = None, 1e-9
        for feature in FEATURES:
            of_bad, of_good = sorted(r[feature] for r in bad), sorted(r[feature] for r in good)
            cuts = thresholds(of_bad)
            for above in (True, False):
                for t in cuts:
                    p, n = (covered(values, above, t) for values in (of_bad, of_good))
                    gain = p * (math.log2(p / (p + n)) - before) if p else 0
                    if gain > gained:
                        best, gained = Condition(feature, above, t), gain
        if best is None:
            break
        chosen += (best,)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return Rule(chosen)


def covered(values: list[int], above: bool, threshold: int) -> int:
    """How many of the sorted values a condition holds for."""
    return len(values) - bisect_left(values, threshold) if above else bisect_right(values, threshold)


def prune(rule: Rule, bad: list[dict[str, int]], good: list[dict[str, int]]) -> tuple[Rule, float]:
    """The beginning of the rule that does best on held-out rows, and its precision there."""
    best, value, precision = rule, -2.0, 0.0
    for size in range(len(rule.conditions), 0, -1):
        shorter = Rule(rule.conditions[:size])
        p, n = sum(map(shorter.holds, bad)), sum(map(shorter.holds, good))
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > value + 1e-12:
            best, value, precision = shorter, worth, p / (p + n) if p + n else 0.0
    return best, precision


def learn(rows: list[dict[str, int]], precision: float = PRECISION, most: int = MOST_RULES) -> list[Rule]:
    """Ordered rules for rejecting, from statistics with `quality` (0: bad) and `fold` (0 is held out for pruning)."""
    bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] != 0]
    rules: list[Rule] = []
    while len(rules) < most:
        grown = [[r for r in side if r["fold"]] for side in (bad, good)]
        held = [[r for r in side if not r["fold"]] for side in (bad, good)]
        if not all(map(len, grown)) or not held[0]:
            break
        rule, right = prune(grow(*grown), *held)
        if not rule.conditions or right < precision:
            break
        rules.append(rule)
        bad, good = [r for r in bad if not rule.holds(r)], [r for r in good if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, what none holds for is kept."""
    if not rules:
        return F.lit(True)
    return F.expr("case " + " ".join(f"when {rule.sql()} then false" for rule in rules) + " else true end")


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict[str, int]]:
    """Statistics of at most `sample` labelled documents, collected; those that the base rule rejects anyway are left out."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    measured = statistics(texts, "doc_id").dropDuplicates(["doc_id"]).where(~base_failed()).join(F.broadcast(chosen), "doc_id")
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) != 0).cast("int").alias("fold")
    asked = measured.select("quality", fold, *(F.expr(e).cast("long").alias(name) for name, e in FEATURES.items()))
    return [row.asDict() for row in asked.orderBy(*asked.columns).limit(sample).collect()]


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every document's statistics with base_failed and kept."""
    rules = learn(labelled_statistics(docs, labels, sample))
    judged = statistics(docs, "doc_id").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, all their columns, without those that the rules reject. One scan: the whole row goes along with its statistics.

    The row is laid out of an array of one or none: a filter would be pushed down below the statistics and repeat them.
    """
    rules = learn(labelled_statistics(docs, labels, sample))
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    return statistics(rows, "__row").select(F.inline(F.when(~base_failed() & verdict(rules), F.array("__row"))))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
