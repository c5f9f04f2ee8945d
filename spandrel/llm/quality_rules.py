"""Quality rules: document statistics in Spark expressions, and a decision list learned from labels.

The list rejects: each rule is a conjunction of thresholds, and a document that any rule covers is rejected. Rules are
found by sequential covering. A rule grows one threshold at a time, by the information it gains on two thirds of the
labelled documents that no earlier rule covers, and is pruned from its end on the other third. All counting is done by
aggregates over binned statistics of a bounded labelled sample; the driver sees one histogram a step. The finished list
is an ordered CASE expression. Nothing on this path runs Python on the executors.

Defined results: a null or wordless text has zeros and fails the base rules; a null label, or one whose document is
missing, teaches nothing, and a doc_id on several rows teaches once, with its smallest text; without labels of both kinds the list is empty and the base rules decide alone; rows of one
doc_id, and a null doc_id, are judged each by their own text; the rules do not depend on how rows are dealt; a very long
text is one row's arrays of hashes, never cut; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, store

SPACE = "[\\x20\\x09-\\x0D]+"
#: Bound of the labelled sample that rules are learned from.
SAMPLE_ROWS = 20_000
MOST_RULES, MOST_TESTS, BINS = 8, 3, 64
#: A rule must be right this often on the documents it is pruned on.
PRECISION = 0.9

#: Ratios the rules may test, from the statistics.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _fenced(value: Column) -> Column:
    """The same value, as an expression that the optimiser moves no filter through: a caller's filter would take the
    arrays' definitions along into the lambdas that read them, and build them once for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the statistics of `_text` to `docs`. The text is never exploded, and of its words only their hashes are kept:
    at most two arrays of longs of a row live at once, 8 bytes a word each.

    Repeated three-word windows: a window's 64-bit hash, its lowest bits replaced by its position, is sorted as a long;
    neighbours that share the upper bits and, looked up by position, the hashes of all three words are repeats.
    """
    rows = docs.withColumn("_bare", F.btrim("_text", F.lit(" \t\n\x0b\x0c\r")))
    rows = rows.withColumn("_h", F.when(F.col("_bare") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("_bare", SPACE), lambda w: F.xxhash64(w))))
    rows = rows.withColumn("n_words", F.size("_h").cast("long")).withColumn("_b", F.expr("length(bin(n_words))"))
    window = "shiftleft(shiftright(xxhash64(h, get(_h, i + 1), get(_h, i + 2)), _b), _b) | i"
    rows = rows.withColumn("_s", F.expr(f"CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(slice(_h, 1, size(_h) - 2), (h, i) -> {window})) END"))
    place = "cast({} & (shiftleft(1L, _b) - 1) as int) + {}"
    same = "shiftright({0}, _b) = shiftright({1}, _b)" + "".join(f" AND get(_h, {place.format('{0}', j)}) = get(_h, {place.format('{1}', j)})" for j in range(3))
    # a window's position where it equals a neighbour
    twice = f"filter(_s, (x, k) -> (k > 0 AND {same.format('x', 'get(_s, k - 1)')}) OR (k + 1 < size(_s) AND {same.format('x', 'get(_s, k + 1)')}))"
    found = f"sort_array(transform({twice}, x -> x & (shiftleft(1L, _b) - 1)))"
    covered = F.expr(f"cast(aggregate({found}, named_struct('n', 0L, 'last', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.last), 'last', p), a -> a.n) as long)")
    rows = rows.withColumn("n_repeat_words", _fenced(covered))
    bare = F.col("_text")
    for space in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(space), F.lit(""))
    rows = rows.withColumn("word_chars", F.length(bare).cast("long"))
    rows = rows.withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
    rows = rows.withColumn("_l", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    rows = rows.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("_h")).cast("long"))
    rows = rows.withColumn("n_upper", F.regexp_count("_text", F.lit("[A-Z]")).cast("long"))
    rows = rows.withColumn("n_marks", F.regexp_count("_text", F.lit("[!?;:]")).cast("long"))
    return rows.drop("_bare", "_h", "_b", "_s", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold: `feature` above it, or not above it."""

    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({RATIOS[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Test, ...]


def rule_sql(rule: Rule) -> str:
    return " AND ".join(t.sql() for t in rule)


def _gain(p: float, n: float, all_p: float, all_n: float) -> float:
    """FOIL's information gain of covering p rejects and n others, out of all_p and all_n."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((all_p + 1e-9) / (all_p + all_n + 1e-9)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]], tests: list[Test]) -> Test | None:
    """The threshold that gains most for a rule so far, from one histogram of all features' bins."""
    inside = rows.filter(rule_sql(tuple(tests))) if tests else rows
    over = lambda f, cut: F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: F.expr(RATIOS[f]) > c))
    bins = F.array(*(F.struct(F.lit(f).alias("f"), over(f, cut).alias("bin")) for f, cut in cuts.items() if cut))
    counts: dict[str, dict[int, list[int]]] = {}
    for f, b, y, n in inside.select("y", F.explode(bins).alias("e")).groupBy("e.f", "e.bin", "y").count().collect():
        counts.setdefault(f, {}).setdefault(b, [0, 0])[y] = n
    if not counts:
        return None
    some = next(iter(counts.values())).values()
    all_n, all_p = (sum(x[y] for x in some) for y in (1, 0))  # a rule covers label 0
    best: tuple[float, Test] | None = None
    for f in sorted(counts):
        p = n = 0
        for k, cut in enumerate(cuts[f]):  # bins 0..k are at or under this cut
            n, p = n + counts[f].get(k, [0, 0])[1], p + counts[f].get(k, [0, 0])[0]
            for above, pp, nn in ((True, all_p - p, all_n - n), (False, p, n)):
                if pp and (gain := _gain(pp, nn, all_p, all_n)) > (best[0] if best else 1e-6):
                    best = gain, Test(f, above, cut)
    return best[1] if best else None


def _prune(rows: DataFrame, tests: list[Test]) -> tuple[Rule, float]:
    """The prefix of a rule that is worth most on the pruning rows, (p - n) / (p + n), and its precision there."""
    sums = [F.sum(F.expr(f"CASE WHEN {rule_sql(tuple(tests[: i + 1]))} AND y = {y} THEN 1 ELSE 0 END")) for i in range(len(tests)) for y in (0, 1)]
    got = [x or 0 for x in rows.agg(*sums).first()]
    worth = [((p - n) / (p + n) if p + n else -1.0, -i) for i, (p, n) in enumerate(zip(got[0::2], got[1::2], strict=True))]
    i = -max(worth)[1]
    p, n = got[2 * i], got[2 * i + 1]
    return tuple(tests[: i + 1]), p / (p + n) if p + n else 0.0


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list from a stored table of statistics with y (1: keep, 0: reject) and `pruning` (boolean)."""
    rows = labelled.filter("NOT base_failed")
    found = rows.agg(*(F.percentile(F.expr(e), [i / BINS for i in range(1, BINS)]).alias(f) for f, e in RATIOS.items())).first()  # exact, of a bounded sample
    steps = {f: sorted(set(found[f] or [])) for f in RATIOS}
    cuts = {f: [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for f, x in steps.items()}  # between what occurs
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and any(cuts.values()):
        tests: list[Test] = []
        while len(tests) < MOST_TESTS and (test := _grow(rows.filter("NOT pruning"), cuts, tests)) and test not in tests:
            tests.append(test)
        if not tests:
            break
        rule, precision = _prune(rows.filter("pruning"), tests)
        if precision < PRECISION:
            break
        rules.append(rule)
        rows = rows.filter(f"NOT ({rule_sql(rule)})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered CASE expression of a list: false at the first rule that covers a document, else true."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {rule_sql(r)} THEN false" for r in rules) + " ELSE true END")


def labelled_statistics(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of about `rows` labelled documents at most. The labels are thinned by a hash of doc_id before the join,
    which bounds the side that is broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).filter("_id is not null and y in (0, 1)").distinct()
    total = known.count()
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    some = some.groupBy("_id", "y").agg(F.min("_text").alias("_text"))  # a doc_id that many rows share teaches once
    made = statistics(some).withColumn("base_failed", base_failed()).withColumn("pruning", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) == 0)
    return store(made.drop("_text"), "labelled-statistics")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    labelled = labelled_statistics(docs, labels)
    rules = learn(labelled)
    discard(labelled)
    rows = statistics(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
