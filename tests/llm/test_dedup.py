"""Substring, near-duplicate and line deduplication against brute force."""

import random

import numpy as np
import pytest
from llm import helpers as H

from spandrel.llm import lines, near_dup, substring
from spandrel.llm.common import Words, expand, slices, squeeze
from spandrel.llm.components import components

ROWS = [H.corpus(1), H.corpus(2, 30), H.odd_rows(), []]


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("n_words", "n_lines", "component_id", "kept", "bucket", "mark", "_text", "ranges", "set_key", "n", "last", "rank", "piece", "length", "score", "key", "tokens")})


@pytest.mark.parametrize("rows", ROWS)
def test_substring(spark, rows):
    same = lambda df: H.same(df, H.substring(rows), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(substring.substring_digest(H.frame(spark, rows)))
    same(substring.substring_digest(clashing(H.frame(spark, rows, 1))))


@pytest.mark.parametrize("rows", ROWS[:3])
def test_substring_with_every_minimiser_hot(spark, rows, monkeypatch):
    scan = Words([(r[1] or "").encode() for r in rows])
    hot = np.unique(substring.super_kmers(scan, 13, np.zeros(0, np.uint64))[2])
    monkeypatch.setattr(substring, "_frequent", lambda *_: hot[::2])
    H.same(substring.substring_digest(H.frame(spark, rows)), H.substring(rows), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_frequent_minimisers_are_found(spark):
    text = " ".join(f"c{i}" for i in range(13))
    rows = [(i, f"a{i} {text} b{i}", "en", "s", 1) for i in range(4000)]
    assert len(substring._frequent(H.frame(spark, rows), 13, 16))
    assert len(substring._frequent(H.frame(spark, H.corpus(3)), 13, 1)) == 0


def test_substring_texts(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage, "en", "s", 1), (2, f"start {passage}  end", "en", "s", 1), (3, "kept   as\nit is", "en", "s", 1), (4, None, None, None, None)]
    got = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(H.frame(spark, rows)).collect()}
    assert got == {1: passage, 2: "start end", 3: "kept   as\nit is", 4: None}


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    scan = Words([" ".join(map(str, range(i, i + 15))).encode() for i in range(0, 60, 5)])
    begins = np.concatenate([f + np.arange(3) for f in scan.first[:-1]])
    doc = np.repeat(np.arange(12), 3)
    want = substring._windows_first(scan, begins, 13, doc)
    monkeypatch.setattr(substring, "_grams", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    assert (substring._windows_first(scan, begins, 13, doc) == want).all()


@pytest.mark.parametrize("rows", ROWS)
@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, rows, words):
    df = near_dup.near_duplicates(clashing(H.frame(spark, rows)), words)
    H.same(df, H.components(rows, words), "doc_id", "n_shingles", "component_id", "kept")


def near_group(n, seed=0):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(100)] = f"e{rng.random()}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("blocks", [(2_000_000, 4096), (3000, 4096), (2_000_000, 40), (2_000_000, 7)])
def test_a_large_group_of_near_copies(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(near_dup, "BLOCK_SETS", blocks[1])
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(near_group(150))]
    H.same(near_dup.near_duplicates(H.frame(spark, rows), 2), H.components(rows, 2), "doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("sets", [512, 9, 3])
def test_a_large_group_of_many_sizes(spark, monkeypatch, sets):
    """Chains of texts that grow word by word, with gaps: links cross the bins of sizes, but not every gap."""
    monkeypatch.setattr(near_dup, "BLOCK_SETS", sets)
    lengths = [n for a, b in ((20, 33), (39, 60), (78, 96), (121, 140)) for n in range(a, b, 3)]
    texts = [" ".join(f"{kind}{i}" if i > 15 else f"w{i}" for i in range(n)) for kind in "ab" for n in lengths]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(random.Random(3).sample(texts, len(texts)))]
    H.same(near_dup.near_duplicates(H.frame(spark, rows), 2), H.components(rows, 2), "doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("most", [near_dup.BROADCAST_NODES, 0])
def test_candidates_are_broadcast_or_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "BROADCAST_NODES", most)
    H.same(near_dup.near_duplicates(H.frame(spark, H.corpus(7)), 2), H.components(H.corpus(7), 2), "doc_id", "n_shingles", "component_id", "kept")


def test_recall_over_brute_force(spark):
    """Every document whose id is divisible by 20 against all, exactly: no link between different sets is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    component = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 2).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = dict(zip([d for d, _ in rows], near_dup.shingle_sets([(t or "").encode() for _, t in rows], 2), strict=True))
    _, codes = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets.values()])
    mark, ids = np.zeros(codes.max() + 1, np.int64), np.array(list(sets))
    begins = ends - [len(s) for s in sets.values()]
    links = 0
    for i in np.flatnonzero(ids % 20 == 0):
        own = codes[begins[i] : ends[i]]
        mark[own] = 1
        sums = np.concatenate(([0], np.cumsum(mark[codes])))
        common = sums[ends] - sums[begins]
        mark[own] = 0
        near = (100 * common >= 80 * (len(own) + ends - begins - common)) & (common > 0)
        links += int(near.sum()) - 1
        assert {component[d] for d in ids[near].tolist()} <= {component[int(ids[i])]}
    assert links > 100


def test_drop_near_duplicates(spark):
    rows = H.corpus(4)
    kept = {r[0] for r in H.components(rows, 5) if r[3]}
    df = near_dup.drop_near_duplicates(H.frame(spark, rows))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r["doc_id"] for r in df.collect()} == kept


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = np.concatenate((a[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64)))
        sig = near_dup.signatures([a, b], 512)
        assert abs((sig[0] == sig[1]).mean() - share / (2 - share)) < 0.08


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("rows", ROWS)
@pytest.mark.parametrize("bound", [lines.BROADCAST_BYTES, -1])
def test_lines(spark, rows, bound):
    df = lines.line_digest(clashing(H.frame(spark, rows)), broadcast_bytes=bound)
    H.same(df, H.lines(rows), "doc_id", "n_lines", "n_dropped", "kept_sha256")


@pytest.mark.parametrize("bound", [lines.BROADCAST_BYTES, -1])
def test_lines_of_documents_on_several_rows(spark, bound):
    """Three rows of two documents are two documents; null ids are none. SQL, brute force and operator agree."""
    import duckdb
    import pandas as pd

    from spandrel.llm.queries import ORACLES

    a, b, c = (f"{x} line of more than twenty characters" for x in ("first", "second", "third"))
    rows = [(1, f"{a}\n{b}"), (1, f"{a}\n{b}\nx"), (2, f"{a}\n{b}\n{c}"), (3, f"{b}\n{c}"), (3, f"{c}\n{b}"), (None, f"{a}\n{b}\n{c}"), (None, b), (None, None), (2, f"{c}\n{a}"), (-5, c), (-5, c)]
    rows = [(d, t, "en", "s", 0) for d, t in rows]
    want = H.lines(rows)
    assert sum(r[2] for r in want) == 7
    H.same(lines.line_digest(H.frame(spark, rows), broadcast_bytes=bound), want, "doc_id", "n_lines", "n_dropped", "kept_sha256")
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    got = db.sql(ORACLES["op4_line_dedup"])
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(dict(zip(got.columns, r, strict=True))[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in got.fetchall()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("bound", [lines.BROADCAST_BYTES, -1])
def test_line_texts(spark, bound):
    shared = "a line of more than twenty characters"
    rows = [(i, f"own {i}\n{shared if i % 2 else shared.upper()} \nend", "en", "s", 0) for i in range(4)] + [(9, None, None, None, None)]
    df = clashing(H.frame(spark, rows))
    got = lines.dedup_lines(df, broadcast_bytes=bound)
    assert got.columns == df.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert found[0] == ("own 0\nend", 9) and found[3][0] == f"own 3\n{shared} \nend" and found[9] == ("", 0)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        made = lines.PerfectHash.build(keys)
        back = lines.PerfectHash.load(*made.dump())
        for hash_ in (made, back):
            assert sorted(hash_.slots(keys).tolist()) == list(range(len(keys)))
        assert len(keys) < 1000 or 8 * (made.words.size + made.ranks.size) < 0.7 * len(keys)
        others = back.slots(rng.integers(1 << 63, 1 << 64, 100, dtype=np.uint64))
        assert ((others >= -1) & (others < max(1, len(keys)))).all()


def test_words():
    texts = [b"", None, b"  a\tb\x0bc ", b"x", "ä ö ü".encode(), b"\n\n", b"end"]
    scan = Words(texts, plain=True)
    want = [(t or b"").split() for t in texts]
    assert scan.counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [scan.data[a:b].tobytes() for a, b in zip(scan.starts, scan.ends, strict=True)] == flat
    assert [scan.plain[a : b - 1] for a, b in zip(scan.at[:-1], scan.at[1:], strict=True)] == flat
    h = Words([b"same word same"]).hashes()
    assert h[0] == h[2] != h[1] and Words([b"other same"]).hashes()[1] == h[0]
    assert len(Words([]).hashes()) == 0 == len(Words([None]).hashes())


def test_slices():
    assert slices([], 10) == [(0, 0)] and slices([b"a" * 5] * 5, 10) == [(0, 2), (2, 4), (4, 5)] and slices([b"a" * 50, None], 10) == [(0, 1), (1, 2)]
    assert expand(squeeze(b"")) == b"" and expand(squeeze(b"abc" * 1000)) == b"abc" * 1000


def test_stored_tables_are_deleted(spark):
    import os

    from spandrel.llm import common

    common.cleanup(spark)
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    assert near_dup.near_duplicates(H.frame(spark, H.corpus(2, 20)), 2).count() == 30
    assert common.STORED
    common.cleanup(spark)
    assert not common.STORED and set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) <= before


def test_the_session_names_the_shared_folder(spark):
    from spandrel.llm.common import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_split_join_equals_a_plain_one(spark):
    from spandrel.llm.components import HOT_ROWS, split_join

    sizes = {1: 5 * HOT_ROWS, 2: HOT_ROWS, 3: HOT_ROWS - 1, 4: 1}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 0), (9, 0)], "k long, i long")
    lows = spark.createDataFrame([(k, -k, n) for k, n in sizes.items()] + [(7, -7, 0)], "k long, low long, _n long")
    found = sorted(map(tuple, split_join(rows, lows, ["k"]).select("k", "i", "low").collect()))
    assert found == sorted((k, i, -k) for k, n in sizes.items() for i in range(n))
    none = rows.filter("false")
    assert split_join(none, lows, ["k"]).isEmpty() and split_join(rows, lows.filter("false"), ["k"]).isEmpty()


def test_many_copies_and_documents_without_words_or_id(spark):
    from spandrel.llm.near_dup import drop_near_duplicates, near_duplicates

    same = "one two three four five six seven"
    rows = [(i, same) for i in range(10, 210)] + [(1, "eight nine ten"), (2, ""), (3, None), (None, same), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in near_duplicates(docs, 2, 80).select("doc_id", "component_id", "kept").collect() if r[0] is not None}
    assert found == {(i, 10, i == 10) for i in range(10, 210)} | {(i, i, True) for i in (1, 2, 3)}
    left = [r[0] for r in drop_near_duplicates(docs, 2, 80).collect()]
    assert sorted(x for x in left if x is not None) == [1, 2, 3, 10] and left.count(None) == 2
