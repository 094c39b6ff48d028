"""Learned quality rules (operator 13), by DataFrame expressions only.

Statistics of whole texts are array and string expressions.  A decision list is
learned from labelled statistics by sequential covering: a rule is grown literal
by literal (a statistic below or above a threshold) on one part of the labelled
rows, pruned on the other, and its rows are taken away before the next rule.
Every step is one aggregation of all labelled rows into counts by statistic and
bin; the list is emitted as an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import held_out, query, sample_of, stored, table
from fieldmark.session import settle

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Base rules: texts with fewer words, or with a larger percentage of their words in repeated windows, go.
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Labelled rows whose percentiles are the candidate thresholds (all rows count for every decision), and how many there are.
CUT_ROWS, CUTS = 20_000, 64
#: Bounds of a list: rules, literals in a rule, and the least precision on the pruning part.
MOST_RULES, MOST_LITERALS, PRECISION = 16, 5, 0.8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test.
FEATURES = ("word_count", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_power", "line_words", "ended_share", "upper_share", "digit_share")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once for a row."""
    return F.transform(F.array(value), use)[0]


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the window hashes in order.

    A window covers its words up to the next such window's start.
    """
    places = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(windows) - 1

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(F.when(k > 0, same(x, k - 1)).otherwise(False) | F.when(k < last, same(x, k + 1)).otherwise(False), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - a, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    return let(places, lambda s: let(twice(s), covered))


def _of_words(words: Column) -> Column:
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))

    def counted(hashes: Column) -> Column:
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        # most texts repeat nothing: only the others are sorted
        repeats = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_repeated(w)))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeats.cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct_words"),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its statistics: counts of words, characters, symbols, lines and repeats.

    A word is a run without the spaces U+0020 and U+0009 to U+000D; a null or empty
    text has none, and every count is 0.  ``n_repeat_words`` counts the words in
    windows of eight words that occur twice or more in the text (told apart by
    64-bit hashes); ``n_dup_lines`` the lines with a word that equal an earlier
    one.  Other columns stay; columns with the names of statistics are replaced.
    """
    given = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(given, SPACES), lambda w: w != "")
    lines = F.filter(F.split(given, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    less = lambda pattern: (F.length(given) - F.length(F.regexp_replace(given, pattern, ""))).cast("long")
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_ended_lines", "n_upper", "n_digits"]
    kept = [c for c in df.columns if c not in (text, *out)]
    found = df.select(
        *[F.col(f"`{c}`") for c in kept],
        let(words, _of_words).alias("__w"), let(lines, _of_lines).alias("__l"),
        less(SYMBOLS).alias("n_symbols"), less("[A-Z]").alias("n_upper"), less("[0-9]").alias("n_digits"),
    )
    flat = found.select(*[F.col(f"`{c}`") for c in kept], "__w.*", "__l.*", "n_symbols", "n_upper", "n_digits")
    return flat.select(*[F.col(f"`{c}`") for c in kept], *out)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, from the columns of ``statistics``; shares of nothing are 0.

    Long texts repeat words more: ``distinct_power`` is the power of a text's words that its different words are.
    """
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    values = (
        F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
        F.coalesce(F.try_divide(F.log1p("n_distinct_words"), F.log1p("n_words")), F.lit(0.0)), share("n_words", "n_lines"), share("n_ended_lines", "n_lines"), share("n_upper", "word_chars"), share("n_digits", "word_chars"),
    )
    return dict(zip(FEATURES, values))


@dataclass(frozen=True)
class Literal:
    """A statistic above (or not above) a threshold."""

    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Literal, ...]


def as_sql(rules: Sequence[Rule]) -> str:
    """The list as an ordered condition over the feature columns: false for the first rule that holds, else true."""
    if not rules:
        return "true"
    cases = " ".join(f"WHEN {' AND '.join(map(str, rule))} THEN false" for rule in rules)
    return f"CASE {cases} ELSE true END"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """How much a literal helps: bad rows that stay covered, times the bits by which they got purer."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def best_literal(counts: dict[tuple[int, int], tuple[int, int]], cuts: Sequence[Sequence[float]]) -> tuple[float, int, bool, int] | None:
    """(gain, feature, above, cut) of the literal with the largest gain; ties go to the earlier feature, below before above, and the lower cut.

    ``counts`` has (bad, good) rows by feature and bin; bin b holds values above the cuts before b and not above cut b.
    """
    best = None
    for f, edges in enumerate(cuts):
        bins = [counts.get((f, b), (0, 0)) for b in range(len(edges) + 1)]
        p0, n0 = (sum(v[k] for v in bins) for k in (0, 1))
        for above in (False, True):
            p = n = 0
            for c in range(len(edges)):
                p, n = p + bins[c][0], n + bins[c][1]
                covered = (p0 - p, n0 - n) if above else (p, n)
                gain = _gain(*covered, p0, n0)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, above, c)
    return best


def cut_points(labelled: DataFrame, names: Sequence[str], rows: int = CUT_ROWS, cuts: int = CUTS) -> list[list[float]]:
    """Candidate thresholds of each feature: percentiles of at most ``rows`` labelled rows, the same at every run."""
    shares = F.array(*[F.lit((k + 0.5) / cuts) for k in range(cuts)])
    sampled = sample_of(labelled, "__hash", rows)
    found = sampled.agg(*[F.percentile(name, shares).alias(name) for name in names]).first()
    return [sorted(set(found[name] or ())) for name in names]


def _bin(name: str, edges: Sequence[float]) -> Column:
    """How many of the cuts are below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda c: c < F.col(name)))


def learn(labelled: DataFrame, names: Sequence[str], bad: Column, key: Column, most_rules: int = MOST_RULES, most_literals: int = MOST_LITERALS, precision: float = PRECISION) -> list[Rule]:
    """A decision list that covers the ``bad`` rows of ``labelled`` and leaves the others.

    ``names`` are numeric columns (null counts as 0), ``key`` tells rows apart: its hash deals them to the
    growing part (two thirds) and the pruning part.  A rule grows by the literal
    with the largest information gain until it covers no good row, is cut back
    to the prefix with the best (bad - good) / (bad + good) on the pruning part, and is
    taken if at least ``precision`` of its pruning rows are bad; else learning
    ends.  Without bad rows, or without good ones, the list is empty.
    """
    hashed = F.xxhash64(F.lit("rules"), key)
    rows = labelled.select(hashed.alias("__hash"), F.coalesce(bad, F.lit(False)).alias("__bad"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    rows = settle(rows)
    n_bad, n_all = rows.agg(F.count_if("__bad"), F.count("*")).first()
    if n_bad in (0, n_all):
        return []
    cuts = cut_points(rows, names)
    bin_of = [_bin(name, edges) for name, edges in zip(names, cuts)]
    left = settle(rows.select((F.pmod(F.shiftright("__hash", 8), F.lit(3)) > 0).alias("__grow"), "__bad", F.array(*bin_of).alias("__bins")))
    rules: list[Rule] = []
    holds = lambda f, above, c: F.get("__bins", F.lit(f)) > c if above else F.get("__bins", F.lit(f)) <= c
    while len(rules) < most_rules:
        chosen: list[tuple[int, bool, int]] = []
        inside = left.where("__grow")
        while len(chosen) < most_literals:
            by_bin = inside.select("__bad", F.posexplode("__bins").alias("f", "b")).groupBy("f", "b").agg(F.count_if("__bad").alias("p"), F.count_if(~F.col("__bad")).alias("n"))
            counts = {(r["f"], r["b"]): (r["p"], r["n"]) for r in by_bin.collect()}  # at most features times (cuts + 1)
            if not sum(n for (f, _), (_, n) in counts.items() if f == 0):
                break
            best = best_literal(counts, cuts)
            if best is None:
                break
            chosen.append(best[1:])
            inside = inside.where(holds(*best[1:]))
        if not chosen:
            break
        checks = []
        covers = F.lit(True)
        for literal in chosen:
            covers = covers & holds(*literal)
            checks += [F.count_if(covers & F.col("__bad")), F.count_if(covers & ~F.col("__bad"))]
        found = left.where("not __grow").agg(*[c.alias(str(k)) for k, c in enumerate(checks)]).first()
        worth = [((p - n) / (p + n), p / (p + n)) if p + n else (-1.0, 0.0) for p, n in zip(found[::2], found[1::2])]
        keep = max(range(len(worth)), key=lambda k: (worth[k][0], -k)) + 1
        if worth[keep - 1][1] < precision:
            break
        rules.append(tuple(Literal(names[f], above, cuts[f][c]) for f, above, c in chosen[:keep]))
        covers = F.lit(True)
        for literal in chosen[:keep]:
            covers = covers & holds(*literal)
        left = left.where(~covers)
    return rules


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows that hold the columns of ``statistics``; ``kept`` is false if the base rules or the list reject a text."""
    verdict = F.expr(as_sql(rules))
    named = df.withColumns(features() | {"base_failed": base_failed()})
    judged_rows = named.withColumn("kept", ~F.col("base_failed") & verdict)
    return judged_rows.select(*[c for c in df.columns if c not in ("base_failed", "kept")], "base_failed", "kept")


def rules_of(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """The list for texts with ``statistics``, from labels (0: bad) of rows that are not held out and pass the base rules.

    Of several labels of one id the smallest counts; a null label none.
    """
    given = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(quality).alias("__quality"))
    labelled = stats.where(~held_out(F.col(doc_id)) & ~base_failed()).withColumns(features()).select(doc_id, *FEATURES).join(given, doc_id)
    return learn(labelled, FEATURES, F.col("__quality") == 0, F.col(doc_id))


@query()
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    rules = rules_of(stats, table(spark, sf_dir, "labels"))
    return judged(stats, rules).select("doc_id", *BASE, "base_failed", "kept")
