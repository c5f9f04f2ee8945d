"""Token counts by a compiled finite-state transducer.

The merge tokenizer is compiled to a deterministic transducer over characters. A state holds what the future can still
ask about the text read so far: its longest suffix that some piece starts with and, at each position inside that
suffix, the last token of the text up to there and the number of tokens so far relative to now. (A sequence of tokens is
what merging gives if and only if every neighbouring pair is, so the last token at a position follows from the last
tokens before it.) Each transition is annotated with the change in emitted tokens, so counting walks the text and adds
annotations. No piece spans from a character to a following space, so a space after anything else leads to one state,
whatever went before, and so does a character that the vocabulary lacks. States are determinised when first reached, and
kept by the worker: their number is bounded, and none holds more text than the longest piece.

A long text is cut into chunks. A chunk is a map from the state before it to the state after it and the tokens between.
Maps compose associatively, without looking at text again, so a prefix scan over the chunks' maps gives the state and the
count at every chunk's end. A chunk's map walks its text once, from the start state; for any other state it walks only
until both walks stand in the same state, from where the rest is known.

Defined results: a null text counts as empty, with no tokens; bytes that are not UTF-8 count as U+FFFD; rows are counted
each, whatever their doc_id; texts of any length, with or without spaces, are counted whole, in memory that grows with
their number of chunks only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_bytes, thrifty

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 1 << 16
#: States that a worker keeps.
MOST_STATES = 200_000
#: Words whose token counts a worker keeps, and the most characters of such a word.
MOST_WORDS, LONGEST_WORD = 200_000, 24
#: Characters between two places at which a chunk's map remembers its walk.
STRIDE = 64

T = TypeVar("T")


class State(dict):
    """The transitions out of a state: by character the state that follows and the change in emitted tokens; a missing one
    is compiled when first asked for. `key`: the live suffix, and (size, last token, tokens relative to now) before each
    of its suffixes that some piece starts with, longest first."""

    __slots__ = ("key", "run")

    def __init__(self, key: tuple, run: Transducer):
        super().__init__()
        self.key, self.run = key, run

    def __missing__(self, char: str) -> tuple[State, int]:
        return self.run.step(self, char)


class Transducer:
    """Counts the tokens of a merge vocabulary with scores: the adjacent pair whose union scores highest merges first,
    the leftmost of equals; characters outside the vocabulary fall back to a token for each byte."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.known = {p for p in scores if len(p) == 1}
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self._fits: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.words: dict[str, int] = {}
        self.start = self._state(("", ((0, None, 0),)))

    def _state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key, self)
        return found

    def merge(self, text: str) -> list[str]:
        """Merging as defined, for the short texts that compilation asks about."""
        parts, scores, none = list(text), self.scores, -float("inf")
        worth = [scores.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while worth and (top := max(worth)) > none:
            i = worth.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            worth[i : i + 1] = []
            if i:
                worth[i - 1] = scores.get(parts[i - 1] + parts[i], none)
            if i < len(worth):
                worth[i] = scores.get(parts[i] + parts[i + 1], none)
        return parts

    def _follows(self, before: str | None, token: str) -> bool:
        """Whether merging leaves these two tokens side by side."""
        key = (before or "", token)
        found = self._fits.get(key)
        if found is None:
            found = self.merge(key[0] + token) == ([before, token] if before else [token])
            if len(self._fits) < 2 * MOST_STATES:
                self._fits[key] = found
        return found

    def step(self, state: State, char: str) -> tuple[State, int]:
        """Compile one transition."""
        if char not in self.known and char != " ":
            return self.start, len(char.encode())  # not kept: there are a million such characters
        suffix, past = state.key
        read = SPACE if char == " " else char
        if read == SPACE and suffix and suffix[-1] != SPACE:
            made = state[char] = self.start[SPACE]
            return made
        read = suffix + read
        end = len(read)
        for size, before, tokens in past:  # the longest piece that may stand after the last token before it
            token = read[end - size - 1 :]
            if token in self.scores and self._follows(before, token):
                break
        delta = tokens + 1
        live = [(n + 1, t, c - delta) for n, t, c in past if read[end - n - 1 :] in self.prefixes]
        key = read[end - live[0][0] :] if live else "", (*live, (0, token, 0))
        if len(self.states) >= MOST_STATES and key not in self.states:
            return State(key, self), delta  # the frequent states are there by now; a rare one is used and forgotten
        made = state[char] = self._state(key), delta
        return made


Exit = tuple[State, int]
Map = Callable[[State], Exit]


def _step_through(state: State, text: str) -> Exit:
    total = 0
    for char in text:
        state, delta = state[char]
        total += delta
    return state, total


def walk(state: State, text: str) -> Exit:
    """The state after a text without `SPACE`, and its change in emitted tokens. A short cut past whole words: between a
    space that follows something else and another space, the change depends on the word alone."""
    parts = text.split(" ")
    state, total = _step_through(state, parts[0])
    if len(parts) == 1:
        return state, total
    run = state.run
    words, (spaced, lead) = run.words, run.start[SPACE]
    apart = bool(parts[0]) or state.key[0][-1:] != SPACE  # what was read last is not a space
    for word in parts[1:-1]:
        if apart and word:
            n = words.get(word)
            if n is None:
                n = lead + _step_through(spaced, word)[1]
                if len(word) <= LONGEST_WORD and len(words) < MOST_WORDS:
                    words[word] = n
            total += n
            continue
        state, n = (spaced, lead) if apart else state[" "]  # one of several spaces, or the word after them
        total += n
        apart = bool(word)
        if word:
            total += _step_through(state, word)[1]
    state, n = (spaced, lead) if apart else state[" "]
    end, m = _step_through(state, parts[-1])
    return end, total + n + m


def same(a: State, b: State) -> bool:
    return a is b or a.key == b.key


class Chunk:
    """The map of a chunk of text without `SPACE`."""

    __slots__ = ("known", "marks", "text")

    def __init__(self, run: Transducer, text: str):
        self.text = text
        state, total = run.start, 0
        self.marks = [(state, 0)]  # of the walk from the start state, after every STRIDE characters and at the end
        for at in range(0, len(text), STRIDE):
            state, n = walk(state, text[at : at + STRIDE])
            total += n
            self.marks.append((state, total))
        self.known: dict[tuple, Exit] = {}

    def __call__(self, state: State) -> Exit:
        key = state.key
        if key not in self.known:
            total = 0
            for i, (mark, counted) in enumerate(self.marks):
                if same(state, mark):
                    self.known[key] = self.marks[-1][0], total + self.marks[-1][1] - counted
                    break
                state, n = walk(state, self.text[i * STRIDE : (i + 1) * STRIDE])
                total += n
            else:
                self.known[key] = state, total
        return self.known[key]


class Then:
    """The map of two neighbouring maps: an exit of the first enters the second, and their tokens add up."""

    __slots__ = ("first", "known", "second")

    def __init__(self, first: Map, second: Map):
        self.first, self.second = first, second
        self.known: dict[tuple, Exit] = {}

    def __call__(self, state: State) -> Exit:
        key = state.key
        if key not in self.known:
            between, n = self.first(state)
            end, m = self.second(between)
            self.known[key] = end, n + m
        return self.known[key]


def scan(items: list[T], compose: Callable[[T, T], T]) -> list[T]:
    """Inclusive prefixes under an associative operation: neighbours are composed, the half as many are scanned, and the
    places between filled in, so all compositions of a level are independent."""
    if len(items) < 2:
        return list(items)
    halves = scan([compose(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], compose)
    return [items[0]] + [halves[i // 2] if i % 2 else compose(halves[i // 2 - 1], items[i]) for i in range(1, len(items))]


def prefix_counts(run: Transducer, text: str, chunk: int = CHUNK) -> list[int]:
    """Tokens of a text up to the end of each chunk, as they would be if it ended there."""
    if not text:
        return []
    start, lead = run.start[SPACE]  # a space precedes every text
    text = text.replace(SPACE, " ")
    maps: list[Map] = [Chunk(run, text[i : i + chunk]) for i in range(0, len(text), chunk)]
    return [lead + upto(start)[1] for upto in scan(maps, Then)]


def count_tokens(run: Transducer, text: str, chunk: int = CHUNK) -> int:
    """Tokens of a whole text."""
    if len(text) > chunk:
        return prefix_counts(run, text, chunk)[-1]
    if not text:
        return 0
    start, lead = run.start[SPACE]
    return lead + walk(start, text.replace(SPACE, " "))[1]


@lru_cache(2)
def compiled(path: str | None = None) -> Transducer:
    """The transducer of a sentencepiece BPE model with byte fallback; one for each worker process."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Transducer({sp.id_to_piece(i): sp.get_score(i) for i in ids})


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(tokenizer_path)
        for batch in thrifty(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            n = [count_tokens(transducer, t.decode("utf-8", "replace")) for t in texts]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
