"""Quality rules: a decision list learned by sequential covering, run as Spark conditions.

Statistics of each text are counted by SQL functions alone. From the labelled ones,
sequential covering learns conjunctions of thresholds that tell poor texts: a rule grows
by the condition with the best information gain, is pruned on documents it has not seen
to what is beyond luck there, and what it covers is set aside before the next rule is grown, until none is good enough;
neither the rules nor the conditions of a rule are limited in number. Each step is one
aggregate over the labelled statistics, cut into at most twice ``BINS`` bins per statistic, so
all labelled documents count and only bin counts reach the driver. The list becomes one
ordered conditional expression.

Null text has no words, and texts without words have all ratios 0. Null labels are left
out; an id with several labels counts with each. Where nothing can be learned, the list is
empty and every text passes it. Rows, repeated ones too, are judged each on its own and by the whole text; other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log2

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sluiceway.llm.common import fold, saved

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 3
BINS = 32
# A rule needs this share of poor texts among those it covers, on the documents for growing and on those for pruning.
PRECISION = 0.97
# And chance would cover so many poor ones, on either, with this probability at most.
CHANCE = 0.001
# Grow on the folds below this one and prune on it; fold 0 is held out.
PRUNE_FOLD = 4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What rules may use, as SQL over the statistics.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "capitals": "n_capitals / word_chars",
    "marks_per_word": "n_marks / n_words",
    "shouts_per_word": "n_shouts / n_words",
    "words_per_line": "n_words / n_lines",
    "n_words": "n_words",
}


def _count_of(characters: str) -> Column:
    """How many characters of ``text`` are in a class; all others go in runs, which is quick."""
    return F.length(F.regexp_replace("text", f"[^{characters}]+", ""))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``key`` and the counts of each text, all of type long; with ``carry`` also the whole row as ``doc``."""
    kept = ["key", "doc"] if carry else ["key"]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    docs = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        *row,
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    # Only the words are of the trimmed text: white space at its ends belongs to its first and last line.
    trimmed = F.btrim("text", F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    counted = docs.select(
        *kept,
        _count_of(r"#*$%&|<>").alias("n_symbols"),
        _count_of("A-Z").alias("n_capitals"),
        _count_of(".,;:").alias("n_marks"),
        _count_of("!?").alias("n_shouts"),
        lines.alias("lines"),
        words.alias("words"),
    )
    # Each step reads the one before several times, so it is computed once, outside any lambda.
    windows = F.expr(
        """transform(slice(arrays_zip(words, slice(words, 2, size(words)), slice(words, 3, size(words))),
            1, greatest(size(words) - 2, 0)), w -> xxhash64(w))"""
    )
    counted = counted.select(
        *kept,
        "n_symbols",
        "n_capitals",
        "n_marks",
        "n_shouts",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        windows.alias("windows"),
    )
    # The low bits of a window's hash above its place: equal windows are neighbours in the order of these numbers.
    counted = counted.withColumn("bits", F.length(F.bin(F.size("windows").cast("bigint"))))
    counted = counted.withColumn(
        "sorted", F.sort_array(F.expr("transform(windows, (w, at) -> shiftleft(w, bits) | at)"))
    )
    place = "cast(get(sorted, {}) & (shiftleft(1L, bits) - 1) AS int)"

    def same(other: str) -> str:
        """Whether entries i and ``other`` have the same whole hash; few pass the first comparison."""
        return f"""(shiftright(get(sorted, i), bits) = shiftright(get(sorted, {other}), bits)
            AND get(windows, {place.format("i")}) = get(windows, {place.format(other)}))"""

    # One other window may stand between two equal ones, if it has the same low bits.
    either = " OR ".join(same(other) for other in ("i - 1", "i + 1", "i - 2", "i + 2"))
    repeated = F.when(F.size("windows") > 1, F.expr(
        f"""transform(filter(sequence(0, size(sorted) - 1), i -> coalesce({either}, false)),
            i -> {place.format("i")})"""
    )).otherwise(F.array().cast("array<int>"))
    counted = counted.withColumn("repeated", F.sort_array(repeated)).drop("windows", "sorted", "bits")
    # Each such window adds the words up to the next one, three at most.
    covered = F.expr(
        f"""aggregate(transform(repeated, (at, i) ->
            least({WINDOW}, coalesce(get(repeated, i + 1) - at, {WINDOW}))), 0, (a, b) -> a + b)"""
    )
    counted = counted.withColumn("n_repeat_words", covered).drop("repeated")
    return counted.select(*kept, *[F.col(c).cast("long").alias(c) for c in counted.columns if c not in kept])


def base_failed() -> Column:
    """The rule that holds without any learning."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    """A statistic as a double; 0 where it would divide by zero."""
    above, _, below = FEATURES[name].partition(" / ")
    if not below:
        return F.col(above).cast("double")
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``feature`` at most, or above, a threshold; ``number`` is the threshold's place among all."""

    feature: str
    above: bool
    threshold: float
    number: int

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def binned(self) -> Column:
        """The same on the bins of the labelled documents."""
        found = F.get("bins", F.lit(list(FEATURES).index(self.feature)))
        return found > self.number if self.above else found <= self.number

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(columns: list[Column]) -> Column:
    held = F.lit(True)
    for column in columns:
        held = held & column
    return held


def _covered(rule: Rule) -> Column:
    return _all([condition.binned() for condition in rule])


def _gain(poor: int, good: int, before_poor: int, before_good: int) -> float:
    if not poor:
        return 0.0
    return poor * (log2(poor / (poor + good)) - log2(before_poor / (before_poor + before_good)))


def _grow(rows: DataFrame, thresholds: list[list[float]]) -> Rule:
    """The conjunction that covering ends at on the documents for growing."""
    rule: Rule = ()
    # Ends, as each condition leaves fewer documents.
    while True:
        counts = (
            rows.filter((F.col("part") < PRUNE_FOLD) & _covered(rule))
            .select("poor", F.posexplode("bins").alias("feature", "bin"))
            .groupBy("feature", "bin")
            .agg(F.sum("poor").alias("poor"), F.sum(1 - F.col("poor")).alias("good"))
            .collect()
        )
        table = {(r["feature"], r["bin"]): (r["poor"], r["good"]) for r in counts}
        poor = sum(p for (f, _), (p, _) in table.items() if f == 0)
        good = sum(g for (f, _), (_, g) in table.items() if f == 0)
        if not poor or not good:
            break
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            below_poor = below_good = 0
            for number, threshold in enumerate(thresholds[f]):
                p, g = table.get((f, number), (0, 0))
                below_poor, below_good = below_poor + p, below_good + g
                for above, p, g in (
                    (False, below_poor, below_good),
                    (True, poor - below_poor, good - below_good),
                ):
                    gain = _gain(p, g, poor, good)
                    if gain > best[0] and p + g < poor + good:
                        best = (gain, Condition(name, above, threshold, number))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def luck(poor: int, covered: int, all_poor: int, everything: int) -> float:
    """How likely ``covered`` documents drawn by chance hold ``poor`` or more of the poor ones."""

    def ways(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    total = 0.0
    for k in range(min(covered, all_poor), max(poor, covered + all_poor - everything) - 1, -1):
        total += exp(ways(all_poor, k) + ways(everything - all_poor, covered - k) - ways(everything, covered))
    return total


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of a rule that is best on the documents for pruning; empty if none is good enough.

    Good enough asks no number of documents, but that the rule is nearly pure and beyond luck.
    """
    if not rule:
        return ()
    sums = [F.sum("poor").alias("poor0"), F.sum(1 - F.col("poor")).alias("good0")]
    for n in range(1, len(rule) + 1):
        held = _covered(rule[:n])
        sums += [
            F.sum(F.when(held, F.col("poor"))).alias(f"poor{n}"),
            F.sum(F.when(held, 1 - F.col("poor"))).alias(f"good{n}"),
        ]
    pruned = (F.col("part") == PRUNE_FOLD).alias("pruned")
    found = {r["pruned"]: r for r in rows.groupBy(pruned).agg(*sums).collect()}
    if len(found) < 2:
        return ()

    def holds(part: Row, n: int) -> bool:
        poor, good = part[f"poor{n}"] or 0, part[f"good{n}"] or 0
        if not poor or poor / (poor + good) < PRECISION:
            return False
        return luck(poor, poor + good, part["poor0"], part["poor0"] + part["good0"]) <= CHANCE

    best = (0, ())
    for n in range(1, len(rule) + 1):
        gained = (found[True][f"poor{n}"] or 0) - (found[True][f"good{n}"] or 0)
        # A shorter rule is kept if a longer one is not better.
        if gained > best[0] and all(holds(part, n) for part in found.values()):
            best = (gained, rule[:n])
    return best[1]


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """The ordered rules that tell poor texts, from all labelled statistics that are not held out."""
    marks = labels.select(
        F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") == 0).cast("int").alias("poor")
    ).filter(F.col("poor").isNotNull())
    rows = stats.filter(~base_failed()).join(marks, "key").withColumn("part", fold(F.col("key")))
    rows = rows.filter("part > 0").select("poor", "part", F.array(*map(feature, FEATURES)).alias("values"))
    rows = saved(rows, "labelled")
    cuts = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    both = []
    for f in range(len(FEATURES)):
        value = F.get("values", F.lit(f))
        both += [F.percentile_approx(F.when(F.col("poor") == poor, value), cuts) for poor in (0, 1)]
    found = rows.agg(*[c.alias(f"cuts{i}") for i, c in enumerate(both)]).first()
    # Thresholds lie half-way between the quantiles of poor and of good texts.
    seen = [sorted({*(found[2 * f] or ()), *(found[2 * f + 1] or ())}) for f in range(len(FEATURES))]
    thresholds = [[(low + high) / 2 for low, high in zip(values, values[1:])] for values in seen]
    if not any(thresholds):
        return []
    # The bin of a value: how many thresholds it is above.
    bounds = F.array(*[F.array(*map(F.lit, t)) for t in thresholds])
    bins = F.zip_with("values", bounds, lambda value, t: F.size(F.filter(t, lambda low: value > low)))
    rows = saved(rows.select("poor", "part", bins.alias("bins")), "binned")
    rules: list[Rule] = []
    # Ends, as each rule covers poor documents that no rule before it does.
    while True:
        rule = _prune(rows, _grow(rows, thresholds))
        if not rule:
            break
        rules.append(rule)
        rows = rows.filter(~_covered(rule))
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that a text breaks, from 1; null if it passes all."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        found = F.when(_all([condition.column() for condition in rule]), F.lit(number)).otherwise(found)
    return found


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    carry: bool = False,
) -> DataFrame:
    """For each row its ``key``, the statistics, ``base_failed``, ``rule`` and ``kept``; with ``carry`` also ``doc``."""
    stats = saved(statistics(docs, key, text, carry), "statistics")
    rules = learn(stats, labels, key, label)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.withColumnRenamed("key", key)
