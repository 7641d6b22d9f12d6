"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditional expressions.

The statistics of a text are plain column expressions. From labelled rows they are cut at quantiles, and each rule is a
conjunction ``statistic <= t AND statistic > t ...`` that is grown condition by condition by FOIL gain on two thirds of
those rows and pruned on the other third; rows it covers are set aside and the next rule is grown. What comes out is a
short list of readable rules, tried in order: ``CASE WHEN rule 1 THEN 'rule 1' ...``.

Fitting takes at most ``fit_limit`` labelled rows (those with the smallest md5 of their id); statistics and verdicts cover
every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.llm.common import WORD, materialize, words

#: Statistics that rules may test, each a share or mean so that thresholds hold for short and long texts alike.
FEATURES = ("symbols_per_word", "marks_per_word", "capital_share", "dup_line_share", "repeat_share", "mean_word", "distinct_share", "words_per_line")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts and shares. Null texts count as empty; shares of an empty text are 0."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("__text"), words(text).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))
    windows = F.expr("transform(sequence(0, size(__words) - 5), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4]))")
    base = base.select(
        "doc_id", "__words", lines.alias("__lines"),
        F.when(F.size("__words") >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit("[!?=@~^_{}\\[\\]|]")).cast("long").alias("n_marks"),
        F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    # Only texts in which a window comes back need its places: sorted with their hashes, equal neighbours are repeats, and
    # a repeat covers five words or as many as lie before the next one.
    base = base.withColumn("__repeats", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    placed = F.when(F.col("__repeats"), F.expr("sort_array(transform(__windows, (h, i) -> struct(h AS h, i AS i)))"))
    base = base.withColumn("__placed", placed)
    again = F.expr(
        "sort_array(transform(filter(transform(__placed, (x, j) -> struct(x.i AS i, "
        "(j > 0 AND __placed[greatest(j - 1, 0)].h = x.h) OR (j < size(__placed) - 1 AND __placed[least(j + 1, size(__placed) - 1)].h = x.h) AS twice)), x -> x.twice), x -> x.i))"
    )
    base = base.withColumn("__again", F.when(F.col("__repeats"), again))
    covered = F.expr("aggregate(__again, struct(0L AS n, -1000000 AS last), (a, i) -> struct(a.n + least(5, i - a.last) AS n, i AS last), a -> a.n)")
    base = base.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_marks", "n_capitals",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # A filter on a statistic must not be pushed below this projection: it would be inlined, and then a lambda would split
        # the text again for every word. An expression that isn't deterministic (and always holds) stops it here.
        F.when(F.col("__repeats") & (F.monotonically_increasing_id() >= 0), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return base.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"), "marks_per_word": share("n_marks", "n_words"),
        "capital_share": share("n_capitals", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"),
        "distinct_share": share("n_distinct", "n_words"), "words_per_line": share("n_words", "n_lines"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def labelled_statistics(docs: DataFrame, labels: DataFrame, label_col: str, fit_limit: int, id_col: str, text_col: str) -> DataFrame:
    """Statistics of the labelled rows that fitting uses. At most ``fit_limit`` ids are broadcast."""
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("label"))
        .orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(fit_limit)
    )
    ids = materialize(sample, "quality-labels")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids.select(F.col("__id").alias("doc_id"))), "doc_id", "left_semi")
    own = own.groupBy("doc_id").agg(F.min("text").alias("text"))  # one row an id, however often it's repeated
    stats = statistics(own).where(~F.col("base_failed"))
    return materialize(stats.join(F.broadcast(ids), stats["doc_id"] == ids["__id"]).select("doc_id", "label", *FEATURES), "quality-statistics")


def learn_rules(rows: DataFrame, bad: int = 0, n_cuts: int = 40, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 10) -> list[Rule]:
    """Sequential covering over ``label`` and FEATURES. What reaches the driver are counts for each combination of cut
    intervals, at most one a labelled row; with no rows, or none of class ``bad``, the list is empty."""
    marks = [i / n_cuts for i in range(1, n_cuts)]
    cut = rows.agg(*[F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cut[f] or [])) for f in FEATURES}
    level = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES}
    grown = F.conv(F.substring(F.md5(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int") % 3 != 0
    counts = rows.select((F.col("label") == bad).alias("bad"), grown.alias("grow"), *[level[f].alias(f) for f in FEATURES]).groupBy("bad", "grow", *FEATURES).count().orderBy("bad", "grow", *FEATURES)
    cells = [(r["bad"], r["grow"], [r[f] for f in FEATURES], r["count"]) for r in counts.collect()]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = [c for c in cells if c[1]], [c for c in cells if not c[1]]
        found = _prune(_grow(grow, cuts, max_conditions), prune or grow)
        hit = [c for c in cells if _covers(found, c)]
        n, good = sum(c[3] for c in hit), sum(c[3] for c in hit if c[0])
        if not found or good < min_covered or good < min_precision * n:
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, above, k in found), n, good / n))
        cells = [c for c in cells if not _covers(found, c)]
    return rules


def _covers(conditions: list, cell: tuple) -> bool:
    return all((cell[2][f] > k) == above for f, above, k in conditions)


def _grow(cells: list, cuts: dict, most: int) -> list:
    """Adds the condition of the largest FOIL gain until no good row is covered, or no condition gains."""
    rule: list = []
    p, n = sum(c[3] for c in cells if c[0]), sum(c[3] for c in cells if not c[0])
    while p and n and len(rule) < most:
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for f, name in enumerate(FEATURES):
            size = len(cuts[name]) + 1
            at = {True: [0] * size, False: [0] * size}
            for bad, _, levels, count in cells:
                at[bad][levels[f]] += count
            p1 = n1 = 0
            for k in range(size - 1):
                p1, n1 = p1 + at[True][k], n1 + at[False][k]
                for above, pp, nn in ((False, p1, n1), (True, p - p1, n - n1)):
                    if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0]:
                        best = (gain, (f, above, k))
        if best[1] is None:
            break
        rule.append(best[1])
        cells = [c for c in cells if _covers([best[1]], c)]
        p, n = sum(c[3] for c in cells if c[0]), sum(c[3] for c in cells if not c[0])
    return rule


def _prune(rule: list, cells: list) -> list:
    """Drops final conditions as long as (p - n) / (p + n) on the pruning rows doesn't fall."""
    def worth(r: list) -> float:
        p = sum(c[3] for c in cells if c[0] and _covers(r, c))
        n = sum(c[3] for c in cells if not c[0] and _covers(r, c))
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (the first that holds, else null) and ``kept``: neither base_failed nor covered by a rule."""
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(r.column(), F.lit(str(r))).otherwise(verdict)
    return stats.withColumn("rule", verdict).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_filter(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_limit: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row of ``docs``, with rules learned from ``labels``.

    Null and empty texts have no words: base_failed, not kept. Labels with a null id or label aren't used; of repeated
    labels of an id the smallest counts. Repeated ids in ``docs`` are judged row by row. Without usable labels only the
    base rules decide. An empty table gives no rows. Other columns aren't read.
    """
    rules = learn_rules(labelled_statistics(docs, labels, label_col, fit_limit, id_col, text_col))
    return apply_rules(statistics(docs, id_col, text_col), rules)
