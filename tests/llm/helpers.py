"""Fixtures of documents and brute-force versions."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    """Small documents with copies, near copies, shared passages and lines, empty, null, short and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünder", "straße", "你好", "don't", "x.", "Y,"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = sentence(30), "  A Shared line that Many documents hold "
    texts = []
    for i in range(n):
        kind, base = i % 10, sentence(rng.randint(20, 90))
        if kind == 1:
            base = texts[rng.randrange(len(texts))] or ""
        elif kind == 2 and texts[0]:
            words = texts[0].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            base = " ".join(words)
        elif kind == 3:
            base += " " + passage + " " + sentence(10)
        elif kind == 4:
            base += "\n" + line + "\n" + sentence(5) + "\n" + line.upper()
        elif kind == 5:
            base = rng.choice(["", " ", "\n", "one", "One two", "\t\x0b", "a b a b a b " * 20, sentence(12), sentence(13)])
        texts.append(base)
    texts += [None, None, "long " + sentence(30_000), "same " * 3000, passage, passage.upper(), line * 3, "x" * 70_000, " nbsp word", "NUL\x00byte"]
    ids = rng.sample(range(len(texts) * 3), len(texts))
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]


def odd_rows():
    """Nulls in every column and repeated rows."""
    shared = " ".join(f"t{i}" for i in range(40))
    return [(None, shared, None, None, None), (5, None, None, "a", None), (5, None, None, "a", None), (7, shared, "en", None, 3), (7, shared, "en", None, 3), (7, "other " + shared, "en", "a", 3), (None, None, None, None, None), (9, shared, "en", "a", 3)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def substring(rows, width=13):
    starts = defaultdict(lambda: float("inf"))
    words = {k: WORD.findall(t or "") for k, (_, t, *_) in enumerate(rows)}
    for k, w in words.items():
        if rows[k][0] is not None:
            for i in range(len(w) - width + 1):
                g = tuple(w[i : i + width])
                starts[g] = min(starts[g], rows[k][0])
    out = []
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if rows[k][0] is not None and starts[tuple(w[i : i + width])] < rows[k][0]:
                gone |= set(range(i, i + width))
        out.append((rows[k][0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def components(rows, words, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if (both and 100 * both >= percent * len(sets[i] | sets[j])) or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                root[find(i)] = find(j)
    low = defaultdict(lambda: float("inf"))
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low[find(i)], r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else low[find(i)], r[0] is None or r[0] == low[find(i)]) for i, r in enumerate(rows)]


def lines(rows, least=20, documents=3):
    """A document is a doc_id; a null one counts for nothing and loses nothing."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least and d is not None:
                held[k].add(d)
    out = []
    for d, t, *_ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if d is None or len(held[key(x)]) < documents or max(held[key(x)]) == d]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def same(df, want, *columns):
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
