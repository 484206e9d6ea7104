"""Quality rules as a learned decision list, in built-in columns only.

Sequential covering: a rule is a conjunction of thresholds grown on labelled statistics, shortened
on other labelled rows, and kept if it is precise there; rows it covers are put aside and the next
rule is grown.  The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.llm.shared import WORD, fold, n_words, save

# Symbols, and the limits of the base rule.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeated", "capitals", "marks")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of ``window`` words found twice or more.

    Windows are hashed; only texts with an equal pair sort them by hash and place.  The flagged
    places, in order, add the words that the one before does not cover.
    """
    def per_text(hashes):
        places = F.when(F.size(hashes) >= window, F.sequence(F.lit(0), F.size(hashes) - window)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))
        return _bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, window)))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), per_text)


def _covered(windows: Column, window: int) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s):
        twice = lambda e, i: (
            F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, twice), lambda e: e["i"]))

    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum"))
    return F.aggregate(_bound(placed, flagged), start, step, lambda a: a["sum"])


def measured(docs: DataFrame) -> DataFrame:
    """Per row the base figures and what the rules look at; a NULL text is empty.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return docs.select(
        F.col("doc_id"), n_words(text).alias("n_words"),
        (F.length(text) - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        _bound(lines, lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_repeat_words"),
        count("[A-Z]").alias("n_capitals"), count("[!?]").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _per(part: str, whole: str, scale: int = 1000) -> Column:
    return F.floor(scale * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")


def rule_features() -> dict[str, Column]:
    """The features of the rules, whole numbers, from the measured columns."""
    return {
        "n_words": F.col("n_words"), "word_length": _per("word_chars", "n_words", 100), "symbols": _per("n_symbols", "word_chars"),
        "dup_lines": F.col("n_dup_lines"), "repeated": _per("n_repeat_words", "n_words"),
        "capitals": _per("n_capitals", "word_chars"), "marks": _per("n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self) -> Column:
        value = rule_features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    rules: int = 8
    conditions: int = 3
    least: int = 8
    precision: float = 0.9


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, none keeps."""

    rules: Sequence[Sequence[Condition]] = field(default_factory=tuple)

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            holds = _all([c.column() for c in rule])
            verdict = F.when(holds, False) if verdict is None else verdict.when(holds, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def learn(figures: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DecisionList:
    """Grow the list from all labelled rows that pass the base rule; ``quality`` 0 is to be rejected.

    Rows without id or label do not count; an id labelled twice counts by its smallest label.  Two
    thirds of the ids grow rules, the rest prunes.  The driver sees counts per feature and bin only.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = figures.where(~base_failed()).join(known, "doc_id")
    values = rule_features()
    rows = save(rows.select(
        (F.col("_quality") == 0).alias("bad"), (fold("doc_id", 3) == 2).alias("prunes"), *(v.alias(k) for k, v in values.items())), "labelled")
    points = [i / settings.bins for i in range(1, settings.bins)]
    cuts = rows.agg(*(F.percentile_approx(k, points, 10_000).alias(k) for k in FEATURES)).first()
    zero = {k: sorted({0, *(cuts[k] or [])}) for k in FEATURES}
    found: list[list[Condition]] = []
    left = rows
    for _ in range(settings.rules):
        rule = _prune(left, _grow(left.where(~F.col("prunes")), zero, settings), settings)
        if not rule:
            break
        found.append(rule)
        left = left.where(~_all([_on(c) for c in rule]))
    return DecisionList(tuple(tuple(r) for r in found))


def _on(c: Condition) -> Column:
    return F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold


def _grow(rows: DataFrame, cuts: dict[str, list[int]], settings: Settings) -> list[Condition]:
    """Add the condition with the largest information gain until the rule is pure or long enough."""
    rule: list[Condition] = []
    while len(rule) < settings.conditions:
        covered = rows.where(_all([_on(c) for c in rule])) if rule else rows
        counts = _counts(covered, cuts)
        bad, good = (sum(counts[FEATURES[0]][k]) for k in (0, 1))
        if not bad or (rule and not good):
            break
        best = max(_gains(counts, cuts, bad, good, settings), default=(0.0, None), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        rule.append(best[1])
    return rule


def _counts(rows: DataFrame, cuts: dict[str, list[int]]) -> dict[str, tuple[list[int], list[int]]]:
    """Bad and good rows per feature and bin; a bin's number is how many thresholds lie below."""
    def bin_of(k):
        edges = F.array(*(F.lit(c) for c in cuts[k]))
        return F.size(F.filter(edges, lambda c: c < F.col(k)))

    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), bin_of(k).alias("b")) for k in FEATURES)))
    out = {k: ([0] * (len(cuts[k]) + 1), [0] * (len(cuts[k]) + 1)) for k in FEATURES}
    for r in rows.select("bad", cells.alias("c")).groupBy("c.f", "c.b").agg(
            F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")).collect():
        out[r.f][0][r.b], out[r.f][1][r.b] = r.bad, r.good
    return out


def _gains(counts, cuts, bad: int, good: int, settings: Settings):
    start = math.log2(bad / (bad + good))
    for k in FEATURES:
        below_bad = below_good = 0
        for i, cut in enumerate(cuts[k]):
            below_bad, below_good = below_bad + counts[k][0][i], below_good + counts[k][1][i]
            for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                if p >= settings.least:
                    yield p * (math.log2(p / (p + n)) - start), Condition(k, above, int(cut))


def _prune(rows: DataFrame, rule: list[Condition], settings: Settings) -> list[Condition]:
    """The beginning of the rule that does best on the other rows; nothing if it is not precise there."""
    if not rule:
        return []
    sums = []
    for n in range(1, len(rule) + 1):
        holds = _all([_on(c) for c in rule[:n]])
        sums += [F.sum((holds & F.col("bad")).cast("long")), F.sum((holds & ~F.col("bad")).cast("long"))]
    found = [x or 0 for x in rows.where("prunes").agg(*sums).first()]
    best, length = max(((found[2 * i] - found[2 * i + 1]) / max(found[2 * i] + found[2 * i + 1], 1), -i) for i in range(len(rule)))
    p, n = found[-2 * length], found[-2 * length + 1]
    return rule[:1 - length] if p >= settings.least / 2 and p >= settings.precision * (p + n) else []


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with its figures, ``base_failed`` and ``kept``: the base rule, else the learned list.

    Without labels nothing is learned and the base rule alone decides.  Equal rows get equal verdicts.
    """
    figures = save(measured(docs), "figures")
    rules = learn(figures, labels, settings)
    return figures.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())
