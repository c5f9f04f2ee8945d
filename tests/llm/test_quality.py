"""Rules, classifier and mixing: statistics against plain versions, held-out accuracy, budgets."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import helpers as H
from pyspark.sql import functions as F

from spandrel.llm import mixing, quality_gam, quality_rules

ROWS = [H.corpus(1), H.odd_rows(), []]
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    w = H.WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    kept = [x for x in (text or "").split("\n") if H.WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(kept) - len(set(kept)), len(cover)


@pytest.mark.parametrize("rows", [*ROWS, [(i, t, "en", "s", 1) for i, t in enumerate(["a b c a b c", "a a a", "a a a a", "#*$%&|<>", "x\nx\n x\n\n\n", "a b c d a b c e b c d", "\n".join(["same line here"] * 40)])]])
def test_statistics(spark, rows):
    labels = spark.createDataFrame([], LABELS)
    got = quality_rules.quality_verdicts(H.frame(spark, rows).withColumn("n_words", F.lit("x")), labels)
    want = []
    for d, t, *_ in rows:
        s = plain_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed))
    H.same(got, want, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_rules_hold_on_documents_they_did_not_see(spark):
    docs, labels = tables(spark)
    seen, rest = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, seen))
    assert rules and all(len(r) <= quality_rules.MOST_TESTS for r in rules)
    rows = quality_rules.quality_verdicts(docs, seen).filter("not base_failed").join(rest, "doc_id").groupBy("kept", "quality").count().collect()
    right = sum(r["count"] for r in rows if r["kept"] == (r["quality"] == 1))
    assert right / sum(r["count"] for r in rows) > 0.95
    assert not any("Python" in x or "Arrow" in x for x in [quality_rules.quality_verdicts(docs, seen)._jdf.queryExecution().executedPlan().toString()])


def plain_verdict(text, rules):
    """The list replayed rule by rule on plainly counted statistics."""
    n, chars, symbols, dup, repeat = plain_statistics(text)
    w = H.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if H.WORD.search(x)]
    value = {
        "word_length": chars / max(n, 1), "symbol_rate": symbols / max(n, 1), "dup_line_rate": dup / max(len(lines), 1), "repeat_rate": repeat / max(n, 1), "words": float(n),
        "upper_rate": len(re.findall("[A-Z]", text or "")) / max(chars, 1), "mark_rate": len(re.findall("[!?;:]", text or "")) / max(n, 1), "distinct_rate": len(set(w)) / max(n, 1),
    }
    if n < 50 or 100 * repeat > 50 * n:
        return False
    return not any(all((value[t.feature] > t.threshold) == t.above for t in rule) for rule in rules)


def test_rules_do_not_depend_on_partitions_and_replay_plainly(spark):
    docs, labels = tables(spark)
    made = []
    for n in (1, 4, 16):
        rules = quality_rules.learn(quality_rules.labelled_statistics(docs.repartition(n), labels.repartition(n)))
        made.append((rules, {tuple(r) for r in quality_rules.quality_verdicts(docs.repartition(n), labels.repartition(n)).collect()}))
    assert made[0] == made[1] == made[2]
    rules, rows = made[0]
    several = (*rules, (quality_rules.Test("upper_rate", False, 0.02), quality_rules.Test("words", True, 120.0)), (quality_rules.Test("distinct_rate", True, 0.9),))
    stats = quality_rules.statistics(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))
    judged = {r["doc_id"]: r["kept"] for r in stats.select("doc_id", (~quality_rules.base_failed() & quality_rules.verdict(list(several))).alias("kept")).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert judged[r["doc_id"]] == plain_verdict(r["text"], several)
        assert next(x[-1] for x in rows if x[0] == r["doc_id"]) == plain_verdict(r["text"], rules)


def test_rules_without_labels(spark):
    docs, labels = tables(spark)
    assert quality_rules.learn(quality_rules.labelled_statistics(docs, labels.filter("quality = 1"))) == []
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (10**9, 0, 0)], LABELS)
    assert quality_rules.learn(quality_rules.labelled_statistics(docs, odd)) == []


def test_classifier_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = quality_gam.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2


def plain_features(text):
    """The classifier's features of one text, counted plainly over its bytes."""
    raw = (text or "").encode()
    w = raw.split()
    size, n = max(1, len(raw)), len(w)
    share = lambda members: sum(b in members for b in raw) / size
    pairs = list(zip(w, w[1:], strict=False))
    kept = [x for x in raw.split(b"\n") if x.strip()]
    marks = b"#$%&*@^~_+=<>/\\`" + b"|{}[]();:" + b"!?"
    return [
        math.log1p(n), sum(map(len, w)) / max(1, n), share(bytes(range(65, 91))), share(b"0123456789"), share(b"#$%&*@^~_+=<>/\\`"), share(b"."), share(b","), share(bytes(range(128, 256))),
        share(b"\n"), share(bytes(x for x in range(32) if x not in (9, 10, 13))), len(set(w)) / max(1, n), len(set(pairs)) / len(pairs) if pairs else 0, max(Counter(w).values(), default=0) / max(1, n),
        sum(len(x) <= 3 for x in w) / max(1, n), sum(x[-1] in marks for x in w) / max(1, n), 1 - len(set(kept)) / len(kept) if kept else 0, share(b"|{}[]();:"), share(b"!?"),
    ]


def test_features_and_scores_are_the_plain_ones(spark):
    """Features in slices equal plain counts, and a score is the sigmoid of the table entries, added one by one."""
    texts = [r[1] for r in H.corpus(1)] + ["", " ", None, "a", "a a", "x! y? (z) #", "ä\n\nä\n"]
    raw = [None if t is None else t.encode() for t in texts]
    got = quality_gam.features(raw)
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-12)
    rng = np.random.default_rng(3)
    model = quality_gam.fit(np.repeat(got, 8, 0) + rng.normal(0, 0.01, (8 * len(got), got.shape[1])), (rng.random(8 * len(got)) < 0.5).astype(float), rounds=5, pair_rounds=3)
    assert model.pairs
    for x, score in zip(got, model.score(got), strict=True):
        z = model.intercept
        for edge, table, value in zip(model.edges, model.tables, x, strict=True):
            z += table[sum(value >= e for e in edge)]
        for (a, b), table in model.pairs.items():
            z += table[sum(x[a] >= e for e in model.coarse[a]), sum(x[b] >= e for e in model.coarse[b])]
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-12


def test_held_out_labels_teach_nothing(spark):
    docs, labels = tables(spark)
    lied = labels.withColumn("quality", F.when(quality_gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality_gam.quality_scores(docs, x).collect()) for x in (labels, lied))
    assert a == b


@pytest.mark.parametrize("rows", ROWS)
def test_classifier_without_labels(spark, rows):
    got = quality_gam.quality_scores(H.frame(spark, rows).withColumn("score", F.lit("x")), spark.createDataFrame([], LABELS))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in rows) and {r["score"] for r in got.collect()} <= {0.5}


def test_keep_quality(spark):
    docs, labels = tables(spark)
    kept = quality_gam.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    good = quality_gam.quality_scores(docs, labels).filter("predicted = 1").count()
    assert kept.count() == good


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000], n_pairs=2, pair_rounds=60)
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality_gam.fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.98


# --- mixing -----------------------------------------------------------------------------------------------------------


def skewed():
    sizes = {"big": 900, "mid": 250, "small": 60, "tiny": 9}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "word " * (i * 37 % 50 + 1), "en", source, 1))
            i += 1
    return rows


def realised(df, rows):
    n = {r[0]: len(H.WORD.findall(r[1] or "")) for r in rows}
    out = Counter()
    for r in df.collect():
        out[r["source"]] += r["copies"] * n[r["doc_id"]]
    return out


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=0.9, repetitions=2.0), mixing.Target(entropy=1.0, repetitions=100.0), mixing.Target(entropy=0.0), mixing.Target(entropy=0.9, repetitions=3.0, budget=2.5)])
def test_mixture_meets_its_target(spark, target):
    rows = skewed()
    df = mixing.mixed_counts(H.frame(spark, rows), target)
    budgets = {r["source"]: r["budget_tokens"] for r in df.select("source", "budget_tokens").distinct().collect()}
    got = realised(df, rows)
    own = Counter()
    for r in rows:
        own[r[3]] += len(H.WORD.findall(r[1]))
    for s, b in budgets.items():
        assert b - 50 <= got[s] <= b
        assert b <= target.repetitions * own[s] * 1.0001 or target.entropy == 0.0
    w = np.array(list(budgets.values())) / sum(budgets.values())
    entropy = -(w * np.log(w)).sum() / math.log(len(w))
    natural = np.array([own[s] for s in budgets]) / sum(own.values())
    assert entropy >= target.entropy - 2e-3 or max((b + 1) / own[s] for s, b in budgets.items()) > target.repetitions * 0.999  # budgets are whole tokens
    assert abs(sum(budgets.values()) - target.budget * sum(own.values())) <= len(own) + 1
    assert entropy >= -(natural * np.log(natural)).sum() / math.log(len(w)) - 1e-9


def test_every_document_at_least_once(spark):
    rows = skewed()
    target = mixing.Target(entropy=1.0, repetitions=1.5, budget=None)
    df = mixing.mixed_counts(H.frame(spark, rows), target).collect()
    assert {r["copies"] for r in df} <= {1, 2} and all(r["copies"] == 1 for r in df if r["source"] == "big")
    mixed = mixing.mix(H.frame(spark, rows).withColumn("copies", F.lit("x")).withColumn("key", F.lit(1)), target)
    assert mixed.columns == [*"doc_id text lang source n_chars copies key".split()]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in df})


@pytest.mark.parametrize("rows", ROWS)
def test_mixing_odd_rows(spark, rows):
    df = mixing.mixed_counts(H.frame(spark, rows), mixing.Target())
    got = df.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in got:
        by.setdefault((r["source"], r["doc_id"]), set()).add(r["copies"])
    assert all(len(x) == 1 for x in by.values())
    assert mixing.mix(H.frame(spark, rows), mixing.Target(budget=None)).count() >= len(rows)


def test_mixing_runs_no_python(spark):
    df = mixing.mixed_counts(H.frame(spark, skewed()), mixing.Target())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_smallest():
    for answer in (0, 1, 5, 777, 1023, 1024):
        assert mixing._smallest(lambda ks: [k >= answer for k in ks], 1024) == answer  # noqa: B023
