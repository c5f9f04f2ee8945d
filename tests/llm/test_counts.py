"""Packing, token counts, media and secrets: against the libraries, exact round trips and plain versions."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import helpers as H

from spandrel.llm import media_flac, packing, secrets, token_counts

ROWS = [H.corpus(1), H.odd_rows(), []]
ODD = ["", " ", "  two", "<|endoftext|>", "a<|endoftext|>b<s></s><unk>", "tab\tand\n\n\nlines  ", "你好，世界", "é" * 300, "=" * 100, "\x00\x01", "don't I'll", "▁▁ x", "😀" * 5, "1234567890" * 9, "   " * 40 + "x", "  "]


# --- packing ----------------------------------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys():
    texts = ODD + [r[1] for r in H.corpus(5) if r[1]]
    encode = packing.encoder(None)
    assert [encode(t) for t in texts] == library_ids(texts)


@pytest.mark.parametrize("char, n", [(" ", 1_000_000), ("\t", 1_000_000), ("\n", 1_000_000), ("\u3000", 1_000_000), ("a", 1_000_000), ("好", 1_000_000), (" ", 5_000_000)])
def test_ids_of_very_long_runs(char, n):
    encode = packing.encoder(None)
    text = f"start {char * n}end"
    assert [encode(text)] == library_ids([text]) and (n > 1_000_000 or encode(char * n) == library_ids([char * n])[0])


def test_white_space_around_the_bound():
    encode = packing.encoder(None)
    texts = [f"a{' ' * n}b{c * n}" for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, packing.LONG_SPACE + 1) for c in "\n <"]
    assert [encode(t) for t in texts] == library_ids(texts)


def test_a_table_with_very_long_texts(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000, "short"])]
    got = packing.pack(H.frame(spark, rows)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {r[0]: len(library_ids([r[1]])[0]) + 1 for r in rows}
    check_slots([(r["sequence_id"], r["offset"], r["length"]) for r in packing.pack(H.frame(spark, rows)).collect()])


@pytest.mark.parametrize("rows", ROWS)
def test_pack(spark, rows):
    got = packing.pack(H.frame(spark, rows), with_ids=True).collect()
    want = []
    for (doc, text, *_), ids in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True):
        ids = [*ids, 2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *([head] if head else []), *range(head + 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=order) == sorted(want, key=order)
    check_slots([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    packed = spark.createDataFrame(got, packing.pack(H.frame(spark, rows[:1]), with_ids=True).schema) if got else None
    if packed:
        whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(packed).collect()}
        for r in got:
            assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])


def check_slots(slots, capacity=1024):
    by = {}
    for s, o, n in slots:
        by.setdefault(s, []).append((o, n))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity


def best_fit(lengths, capacity):
    """Best-fit decreasing, item by item."""
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((r for r in bins if r >= n), default=None)
        if room is None:
            bins.append(capacity - n)
        else:
            bins[bins.index(room)] = room - n
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in lengths}
    runs, opened = packing.plan(histogram, 32)
    assert opened == best_fit(lengths, 32)
    slots = [(int(s) + i, int(o), int(n)) for n, _, count, s, o in runs for i in range(count)]
    assert sorted(n for _, _, n in slots) == sorted(lengths)
    check_slots(slots, 32)
    for n in histogram:
        ranks = [r + i for length, r, count, *_ in runs.tolist() if length == n for i in range(count)]
        assert sorted(ranks) == list(range(histogram[n]))


# --- token counts -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("rows", ROWS)
def test_token_counts(spark, rows, pieces):
    want = [(d, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for d, t, *_ in rows]
    H.same(token_counts.token_counts(H.frame(spark, rows)), want, "doc_id", "n_bytes", "n_tokens", "over_limit")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["the", " in", "ing", "  ", "a", "e", "th", "==", "▁", "\n", "é", "<0x0A>", "</s>", " " * 15, " " * 33, "aaaa", "----"]), st.text(max_size=3)), max_size=12), st.integers(1, 7))
def test_transducer_equals_the_library(pieces, parts, chunk):
    text = "".join(parts)
    run = token_counts.compiled()
    assert token_counts.count_tokens(run, text) == len(pieces.encode(text)) == token_counts.count_tokens(run, text, chunk)


def test_repeated_characters(pieces):
    run = token_counts.compiled()
    for char in "=-*#ao. _é":
        for n in (1, 2, 3, 15, 16, 17, 31, 32, 47, 64, 200):
            assert token_counts.count_tokens(run, char * n) == len(pieces.encode(char * n))


def test_a_full_table_of_states_counts_the_same(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 20)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 5)
    run = token_counts.Transducer(token_counts.compiled().scores)
    for text in ODD + [r[1] for r in H.corpus(6)[:20] if r[1]]:
        assert token_counts.count_tokens(run, text) == len(pieces.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", " in", "ing", "  ", "a", "e", " ", "==", "\n", "é", "ʘ", "---", " " * 17]), max_size=14), st.integers(1, 7))
def test_chunk_maps_compose(pieces, parts, chunk):
    """Maps hold for any state, composition is associative, and a scan gives the counts of all prefixes."""
    run = token_counts.compiled()
    text = "".join(parts)
    cut = [text[i : i + chunk] for i in range(0, len(text), chunk)]
    entries = [run.start, run.start["a"][0], run.start[" "][0]["t"][0], run.start[" "][0][" "][0], run.start["-"][0]["-"][0]]
    maps = [token_counts.Chunk(run, t) for t in cut]
    for state in entries:
        at, total = state, 0
        for t, one in zip(cut, maps, strict=True):
            step, n = one(at)
            walked, m = token_counts.walk(at, t)
            assert n == m and token_counts.same(step, walked)
            at, total = step, total + n
        for compose in (lambda a, b: token_counts.Then(a, b),):
            left = right = None
            for one in maps:
                left = compose(left, one) if left else one
            for one in reversed(maps):
                right = compose(one, right) if right else one
            for whole in (left, right):
                if whole:
                    end, n = whole(state)
                    assert n == total and token_counts.same(end, at)
    assert token_counts.prefix_counts(run, text, chunk) == [len(pieces.encode(text[: i + chunk])) for i in range(0, len(text), chunk)]


def test_scan():
    for n in range(20):
        assert token_counts.scan([str(i) for i in range(n)], lambda a, b: a + b) == ["".join(map(str, range(i + 1))) for i in range(n)]


def test_spaceless_texts_leave_little_behind(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 3000)
    rng = random.Random(8)
    run = token_counts.Transducer(token_counts.compiled().scores)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    held = []
    for _ in range(6):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert token_counts.count_tokens(run, text, 1000) == len(pieces.encode(text))
        held.append(len(run.states) + sum(map(len, run.words)))
    assert held[1:] == held[:1] * 5 and len(run._fits) <= 2 * 3000 and not run.words
    for text in ("你好" * 10_000, "word" + " " * 5000 + "x" * 5000):
        assert token_counts.count_tokens(run, text, 777) == len(pieces.encode(text))


# --- media ------------------------------------------------------------------------------------------------------------


def back(stream):
    samples, blocks = media_flac.decode_streams([stream])[0]
    return (samples.view(np.uint8) ^ 0x80).tobytes(), blocks


SIGNALS = {
    "silence": b"\x80" * 576 * 3,
    "noise": random.Random(0).randbytes(576 * 4),
    "sine": ((100 * np.sin(np.arange(576 * 4) / 40)).astype(np.int8).view(np.uint8) ^ 0x80).tobytes(),
    "text": media_flac.payload(b"some text, some more text " * 60),
    "steps": bytes([0, 255] * 288 * 2),
}


@pytest.mark.parametrize("name", list(SIGNALS))
@pytest.mark.parametrize("orders, linear, seek", [((0, 1, 2), False, True), ((), False, True), ((0, 1, 2, 3, 4), False, False), ((), True, True), ((3,), True, False)])
def test_flac_round_trip(name, orders, linear, seek):
    stream = media_flac.encode_streams([SIGNALS[name]], orders, linear, seek)[0]
    got, blocks = back(stream)
    assert got == SIGNALS[name]
    assert [b[0] for b in blocks] == list(range(0, len(got), 576))
    assert all(stream[b[1] : b[1] + 2] == b"\xff\xf8" for b in blocks)


def test_flac_predicts():
    size = lambda orders, linear: len(media_flac.encode_streams([SIGNALS["sine"]], orders, linear)[0])
    assert size((), True) < 0.6 * size((), False) and size((0, 1, 2), False) < 0.6 * size((), False)


def test_many_streams_at_once():
    rng = random.Random(2)
    payloads = [media_flac.payload(rng.randbytes(rng.randrange(40_000))) for _ in range(60)] + [media_flac.payload(None)]
    streams = media_flac.encode_streams(payloads, linear=True)
    mixed = [s if i % 2 else media_flac.encode_streams([p], seek=False)[0] for i, (s, p) in enumerate(zip(streams, payloads, strict=True))]
    assert [(s.view(np.uint8) ^ 0x80).tobytes() for s, _ in media_flac.decode_streams(mixed)] == payloads


def test_long_streams_number_their_frames():
    payload = random.Random(1).randbytes(576 * 2200)
    stream = media_flac.encode_streams([payload])[0]
    assert back(stream)[0] == payload
    assert [media_flac._coded_number(n).hex() for n in (0, 127, 128, 2047, 2048, 65536)] == ["00", "7f", "c280", "dfbf", "e0a080", "f0908080"]


def test_more_frames_than_seek_points(monkeypatch):
    payload = random.Random(1).randbytes(576 * 50)
    whole = media_flac.read_metadata(media_flac.encode_streams([payload])[0])
    monkeypatch.setattr(media_flac, "MOST_POINTS", 7)
    stream = media_flac.encode_streams([payload])[0]
    points = media_flac.read_metadata(stream).points
    assert len(whole.points) == 50 and points.tolist() == whole.points[::8].tolist()
    assert back(stream)[0] == payload and len(back(stream)[1]) == 50


def test_damage_is_found():
    stream = media_flac.encode_streams([SIGNALS["text"]])[0]
    start = stream.index(b"\xff\xf8")
    for at in (0, 8, start + 2, start + 5, start + 40, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        if at == 8:
            continue
        with pytest.raises((media_flac.FlacError, IndexError)):
            media_flac.decode_streams([bytes(bad)])


def escaped_stream():
    """One frame, written by hand: fixed order 0, one partition of raw 5-bit residuals."""
    samples = [(i * 7) % 32 - 16 for i in range(576)]
    bits = f"{8 << 1:08b}" + "00" + "0000" + "1111" + f"{5:05b}" + "".join(f"{s & 31:05b}" for s in samples)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    head = media_flac._header(0)
    raw = np.frombuffer(head + body, np.uint8)
    crc = int(media_flac._crc(raw, np.array([0]), np.array([len(raw)]), 16)[0])
    info = (576).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 576).to_bytes(8) + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3) + info + raw.tobytes() + crc.to_bytes(2), samples


def test_escaped_residuals():
    stream, samples = escaped_stream()
    assert media_flac.decode_streams([stream])[0][0].tolist() == samples


def plain_crc(data, poly, bits):
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly) if crc >> (bits - 1) & 1 else crc << 1
            crc &= (1 << bits) - 1
    return crc


def test_checksums():
    data = random.Random(3).randbytes(700)
    raw = np.frombuffer(data, np.uint8)
    starts, ends = np.array([0, 5, 100, 7]), np.array([700, 6, 130, 7])
    for bits, poly in ((16, 0x8005), (8, 0x07)):
        assert media_flac._crc(raw, starts, ends, bits).tolist() == [plain_crc(data[a:b], poly, bits) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("rows", ROWS)
def test_media_query(spark, rows):
    df = media_flac.media_digest(H.frame(spark, rows))
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d, len(raw), len(p), __import__("hashlib").sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    H.same(df, want, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    rows_ = df.collect()
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows_}) == len({r["payload_sha256"] for r in rows_})


def test_the_query_reads_linear_subframes_through_blocks(spark, monkeypatch):
    """Streams of the query hold linear subframes, which are smaller, and its digest is what their blocks say."""
    docs = H.frame(spark, H.corpus(1))
    media = {r["doc_id"]: bytes(r["media"]) for r in media_flac.to_media(docs).collect()}
    kinds = set()
    for stream in media.values():
        for _, byte, _ in back(stream)[1]:
            header, _ = media_flac._frame_header(stream, byte)
            kinds.add(stream[byte + header] >> 1 & 63)
    assert 32 + media_flac.LPC_ORDER - 1 in kinds
    pcm = {}
    for r in media_flac.pcm_blocks(media_flac.to_media(docs)).collect():
        pcm.setdefault(r["doc_id"], {})[r["sample_offset"]] = bytes(r["pcm"])
    for r in media_flac.media_digest(docs).collect():
        raw = b"".join(v for _, v in sorted(pcm[r["doc_id"]].items()))
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(raw), __import__("hashlib").sha256(raw).hexdigest())
        assert r["media_sha256"] == __import__("hashlib").sha256(media[r["doc_id"]]).hexdigest()
    batch = media_flac.to_media(H.frame(spark, H.corpus(1)[:1])).toArrow().to_batches()[0]
    (_, _, blocks) = next(media_flac._blocks(batch))
    assert media_flac._payload_of(blocks[::-1]) == media_flac._payload_of(blocks) != media_flac._payload_of([(a, b, n, bytes(n)) for a, b, n, _ in blocks])


def test_pcm_blocks(spark):
    media = media_flac.to_media(H.frame(spark, H.corpus(1)[:20]))
    blocks = media_flac.pcm_blocks(media).collect()
    texts = {r[0]: media_flac.payload((r[1] or "").encode()) for r in H.corpus(1)[:20]}
    for d, text in texts.items():
        own = sorted((b["sample_offset"], bytes(b["pcm"])) for b in blocks if b["doc_id"] == d)
        assert b"".join(p for _, p in own) == text


# --- secrets ----------------------------------------------------------------------------------------------------------


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


CASES = [
    "password=hunter2hunter2", "PassWord : 'abcdefgh'", "secret: token: abcdefghij", "token=token=abcdefgh12", "api_key=\"12345678\" apikey:x", "ſecret=abcdefgh12 toKen=abcdefgh12",
    "AKIA" + "A1" * 6, "AKIA" + "A" * 11, "xAKIAAKIAAKIAAKIA1", "0" * 31 + " " + "a" * 32 + "g", "é token = " + "deadbeef" * 5, "", "password=", "passwd=...........",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CASES, " ", "=", ":", "'", "token", "é", "AKIA", "deadbeef" * 4, "abcdefgh"]), max_size=8))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.listed(secrets.base_spans(text)) == ",".join(s for *_, s in sorted(plain_spans(text)))


def credentials(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]


def test_inferred_formats():
    rng = random.Random(1)
    words = ["".join(rng.choice(["the", "an", "ing", "er", "st", "on", "wh"]) for _ in range(8)) for _ in range(300)]
    keyed = ["ghp" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(200)]
    formats = secrets.train({"assign": keyed, "hex": credentials(200), "background": words})
    assert all(formats.kind(x) == "like_hex" for x in credentials(50, 9))
    fresh = ["ghp" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(50)]
    assert sum(formats.kind(x) == "like_assign" for x in fresh) >= 48
    more = ["".join(rng.choice(["the", "an", "ing", "er", "st", "on", "wh"]) for _ in range(8)) for _ in range(300)]
    assert not any(formats.kind(x) for x in more)
    assert secrets.train({"hex": credentials(3)}) is None


def test_inference_merges_states():
    automaton = secrets.infer([c.translate(secrets._CLASS_OF) for c in credentials(300)])
    tree = len({c.translate(secrets._CLASS_OF)[:i] for c in credentials(300) for i in range(41)})
    assert len(automaton.moves) < tree / 50
    assert automaton.likelihood("0a" * 20) > automaton.likelihood("gG" * 20)


def test_secret_query(spark):
    hexes = credentials(60)
    rows = [(i, f"some words here token = \"{h}\" and more thananthereringing", "en", "s", 1) for i, h in enumerate(hexes)]
    rng = random.Random(4)
    rows += [(200 + i, "ordinary " + "".join(rng.choice(["the", "an", "ing", "er"]) for _ in range(9)), "en", "s", 1) for i in range(600)]
    rows += [(100, f"no keyword but {credentials(1, 77)[0][:31]} here", "en", "s", 1), (101, None, None, None, None), (None, "secret=abcdefghi", "en", None, None)]
    got = {r["doc_id"]: r for r in secrets.secret_digest(H.frame(spark, rows)).collect()}
    assert got[0]["n_assign"] == 1 and got[0]["n_hex"] == 1 and got[0]["spans"].startswith("assign:16:")
    assert got[0]["base_sha256"] == H.sha(got[0]["spans"]) and got[100]["spans"].startswith("like_") and got[100]["base_sha256"] == H.sha("")
    assert got[101]["spans"] == "" and got[None]["n_assign"] == 1
    for rows in ROWS:
        found = secrets.secret_digest(H.frame(spark, rows)).collect()
        assert len(found) == len(rows)
    spans = secrets.secret_spans(H.frame(spark, [(1, "token=abcdefgh1", "en", "s", 1)]), None).collect()
    assert [(r["kind"], r["start"], r["end"], r["credential"]) for r in spans] == [("assign", 0, 15, "abcdefgh1")]


def many_credentials():
    """Rows with more credentials and ordinary tokens than the sample takes."""
    rng = random.Random(12)
    ordinary = lambda: "".join(rng.choice(["the", "an", "ing", "er", "st", "on", "wh", "un"]) for _ in range(rng.randint(7, 11)))
    near = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 31)))
    rows = [(i, f"see token = {h} {ordinary()}", "en", "s", 1) for i, h in enumerate(credentials(700, 3))]
    rows += [(1000 + i, " ".join(ordinary() for _ in range(4)), "en", "s", 1) for i in range(900)]
    return rows + [(3000 + i, f"{near()} here token = {near()}{near()} or {near()}, {near()}", "en", "s", 1) for i in range(60)]


def test_the_same_formats_for_any_partitioning(spark):
    rows = many_credentials()
    found = [{tuple(r) for r in secrets.secret_digest(H.frame(spark, rows, n)).collect()} for n in (1, 4, 16)]
    assert found[0] == found[1] == found[2] and sum("like_" in r[5] for r in found[0]) > 50
    value = [v for _, t, *_ in rows[:50] for v in t.split()] + ["é", ""]
    df = spark.createDataFrame([(v,) for v in value], "v string").selectExpr("v", "xxhash64(v) AS h")
    assert all(secrets._order(r["v"])[0] == r["h"] for r in df.collect())


def plain_added(text, formats):
    """Added spans, every token against every base span, and likelihoods term by term."""

    def likelihood(automaton, token):
        state, terms = 0, []
        for c in token:
            symbol = next((k for k, members in secrets._CLASSES.items() if c in members), c)
            target, term = automaton.moves[state].get(symbol, (state, automaton.unseen))
            state = target
            terms.append(term)
        return math.fsum([*terms, automaton.stops[state]])

    base, out = secrets.base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text):
        if any(a < m.end() and m.start() < b for a, b, *_ in base):
            continue
        gains = {k: likelihood(a, m[0]) - likelihood(formats.background, m[0]) for k, (a, least) in formats.kinds.items() if len(m[0]) >= least}
        if gains and max(gains.values()) >= secrets.GAIN * len(m[0]):
            out.append((m.start(), m.end(), "like_" + max(gains, key=lambda k: (gains[k], k)), m[0]))
    return out


def test_added_spans_are_those_of_brute_force(spark):
    rows = many_credentials()
    formats = secrets.learn(H.frame(spark, rows))
    found = 0
    for _, text, *_ in rows:
        base, added = secrets.scan(text, formats)
        assert base == secrets.base_spans(text) and added == plain_added(text, formats)
        found += len(added)
    assert found > 50


def test_many_spans_take_linear_time():
    import time

    text = " ".join(f"token={'abcdefgh' + str(i)} {'x' * 20}{i}" for i in range(40_000))
    began = time.perf_counter()
    assert len(list(secrets._candidates(text, secrets.base_spans(text)))) == 40_000
    assert time.perf_counter() - began < 10
