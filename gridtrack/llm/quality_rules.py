"""Quality rules as learned decision lists; DataFrame functions only.

Statistics of a text (words, symbols, repeated lines and windows, letter case) are
Spark columns. From the statistics of a bounded sample of labelled documents,
sequential covering grows conjunctions of thresholds for low quality, prunes each on
rows kept aside, and stops when a rule is not precise enough. The list is emitted as
one ordered conditional expression.

Null counts as a text without words. Windows are compared by 64-bit hashes inside one
text. Repeated rows get the same verdict. Without labels the list is empty. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, SPACES, bounded

WINDOW = 5
BLANKS = r"[ \t\n\x0B\f\r]+"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")


@dataclass(frozen=True)
class RuleParams:
    #: Bound of the labelled rows whose statistics are collected.
    max_rows: int = 20_000
    max_rules: int = 12
    max_conditions: int = 4
    thresholds: int = 24
    #: Least share of low quality, on grown and on pruning rows, and least rows that a rule covers.
    precision: float = 0.95
    least: int = 5


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows found twice or more. Windows' hashes are sorted with their places; equal neighbours repeat."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i + 1)["h"]) | (p["h"] == F.get(pairs, i - 1)["h"]))
        return _let(F.array_sort(F.transform(twice, lambda p: p["i"])), covered)

    def of(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(pairs, repeated))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(windows(words), of))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    per_row = F.struct(
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        without(A_Z).alias("upper"), without("0123456789").alias("digits"), without("!?").alias("marks"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeat"))).alias("words"),
    )
    rows = rows.select("doc_id", F.explode(F.array(per_row)).alias("s"))  # explode: the statistics are worked out once, below all that uses them
    n, chars = F.col("s.words.n"), F.greatest(F.col("s.word_chars"), F.lit(1))
    return rows.select(
        "doc_id", n.cast("long").alias("n_words"), "s.word_chars", "s.n_symbols",
        F.col("s.lines.dup").cast("long").alias("n_dup_lines"), F.col("s.words.repeat").cast("long").alias("n_repeat_words"),
        (F.col("s.word_chars") / F.greatest(n, F.lit(1))).alias("mean_word"), (F.col("s.n_symbols") / chars).alias("symbol_share"),
        (F.col("s.lines.dup") / F.greatest(F.col("s.lines.n"), F.lit(1))).alias("dup_line_share"), (F.col("s.words.repeat") / F.greatest(n, F.lit(1))).alias("repeat_share"),
        (F.col("s.upper") / chars).alias("upper_share"), (F.col("s.digits") / chars).alias("digit_share"), (F.col("s.marks") / chars).alias("mark_share"),
        (F.col("s.words.distinct") / F.greatest(n, F.lit(1))).alias("distinct_share"),
    )


Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]


def _holds(row: dict, rule: Rule) -> bool:
    return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in rule)


def learn(rows: list[dict], params: RuleParams = RuleParams()) -> list[Rule]:
    """rows: the statistics and `low` (1: low quality). Every third row is kept aside to prune on."""
    grow, aside = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < params.max_rules and any(r["low"] for r in grow):
        rule, inside = (), grow
        while len(rule) < params.max_conditions and any(not r["low"] for r in inside):
            low, n = sum(r["low"] for r in inside), len(inside)
            best = (0.0, None)
            for f in FEATURES:
                order = sorted((r[f], r["low"]) for r in inside)
                sums = [0]
                for _, y in order:
                    sums.append(sums[-1] + y)
                cuts = sorted({round(i * n / params.thresholds) for i in range(1, params.thresholds)} | {i for i in range(1, n) if order[i - 1][1] != order[i][1] and (i < 200 or i > n - 200)})
                for i in cuts:
                    if 0 < i < n and order[i - 1][0] < order[i][0]:
                        t = round((order[i - 1][0] + order[i][0]) / 2, 6)
                        if order[i - 1][0] <= t < order[i][0]:
                            for op, y, k in (("<=", sums[i], i), (">", low - sums[i], n - i)):
                                if y >= params.least:  # gain: covered low rows times the rise of precision
                                    best = max(best, (y * (y / k - low / n), (f, op, t)), key=lambda z: z[0])
            if best[1] is None:
                break
            rule += (best[1],)
            inside = [r for r in inside if _holds(r, (best[1],))]
        def worth(x: Rule) -> float:
            c = [r["low"] for r in aside if _holds(r, x)]
            return (2 * sum(c) - len(c)) / len(c) if c else -1.0
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        own, other = ([r["low"] for r in part if _holds(r, rule)] for part in (grow, aside))
        if not rule or len(own) < params.least or sum(own) < params.precision * len(own) or sum(other) < params.precision * len(other):
            break
        rules.append(rule)
        grow, aside = ([r for r in part if not _holds(r, rule)] for part in (grow, aside))
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, op, t in rule:
            test = test & (F.col(f) > t if op == ">" else F.col(f) <= t)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def train(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """Learns from the statistics of at most max_rows labelled documents."""
    labels = bounded(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").distinct(), "doc_id", params.max_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(labels), "doc_id").select("doc_id", *FEATURES, (F.col("quality") == 0).cast("int").alias("low")).orderBy("doc_id").limit(2 * params.max_rows)
    return learn([r.asDict() for r in rows.collect()], params)


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, the number of the rule that fired, kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = statistics(docs).withColumns({"base_failed": failed, "rule": expression(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
