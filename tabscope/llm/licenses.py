"""Licence scan with a generalised suffix automaton of licence texts.

The automaton holds every run of words of all templates. A text is streamed
through it; at each word it gives the longest run that ends there and occurs in
a template. Long runs are chained, in the order of a template, into the span of
the text that the template covers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import bound_arrow_batches
from tabscope.llm.license_texts import NOTICES, WHOLE

#: Labels and texts, told to every task: some thousands of words.
Texts = tuple[tuple[str, str], ...]
#: Phrases that always count, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Bytes of words: digits, a-z and all beyond ASCII; the rest cuts, and A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Rules:
    """A match counts from ``least`` words on, and a chain may skip ``gap`` words.

    A span needs the share ``cover`` of a notice, or ``part`` of a whole licence.
    Of whole licences that share sentences, a place in a text has the one that
    covers most words there.
    """

    least: int = 3
    gap: int = 6
    cover: float = 0.8
    part: float = 0.15


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last_of: list[list[int]] = []
        for words in sequences:
            last, states = 0, []
            for word in words:
                last = self._extend(last, word)
                states.append(last)
            last_of.append(states)
        #: For each state, the templates that hold its run and where the run first ends in them.
        self.ends: list[dict[int, int]] = [{} for _ in self.link]
        for t, words in enumerate(sequences):
            state = 0
            for i, word in enumerate(words, 1):
                state = self.next[state][word]
                self.ends[state].setdefault(t, i)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            above = self.ends[self.link[state]]
            for t, i in self.ends[state].items():
                above[t] = min(i, above.get(t, i))

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, before: int, word: int) -> int:
        """The state that ``word`` leads to from ``before``, cut so that it has just this longest run."""
        at = self.next[before][word]
        if self.length[at] == self.length[before] + 1:
            return at
        copy = self._state(self.length[before] + 1, dict(self.next[at]), self.link[at])
        self.link[at] = copy
        while before >= 0 and self.next[before].get(word) == at:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """Runs that can't be made longer to either side: (start, length, state)."""
        state = length = 0
        for i, word in enumerate(words):
            before, had = state, length
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state = length = 0
            if length <= had and had >= least:
                yield i - had, had, before
        if length >= least:
            yield len(words) - length, length, state


class Scanner:
    """Phrases and templates of one worker."""

    def __init__(self, whole: Texts, notices: Texts, phrases: Texts, rules: Rules):
        templates = (*whole, *notices)
        self.rules, self.labels = rules, [label for label, _ in templates]
        self.least_share = [rules.part] * len(whole) + [rules.cover] * len(notices)
        self.n_whole = len(whole)
        texts = [text.encode().translate(WORD_BYTES).split() for _, text in templates]
        phrase_words = [text.encode().split() for text, _ in phrases]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts + phrase_words for w in t))}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[self.ids[w] for w in t] for t in texts])
        self.phrases = [([self.ids[w] for w in p], label) for p, (_, label) in zip(phrase_words, phrases, strict=True)]

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """Every place of a phrase: (first word, label)."""
        out = []
        for words, label in self.phrases:
            if len(ids) >= len(words):
                n = len(ids) - len(words) + 1
                at = np.flatnonzero(ids[len(words) - 1 :] == words[-1])
                for k, w in enumerate(words[:-1]):
                    at = at[ids[at + k] == w]
                out += [(int(i), label) for i in at if i < n]
        return sorted(out)

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Covered template spans: (label, first word, end, share of the template)."""
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
        runs = edges[edges[:, 1] - edges[:, 0] >= self.rules.least]
        chains: dict[int, list[int]] = {}  # template: first word, end, place in the template, words covered
        out: list[tuple[str, int, int, float]] = []
        parts: list[tuple[int, int, int, int]] = []

        def close(t: int) -> None:
            first, end, _, covered = chains.pop(t)
            share = min(1.0, covered / self.sizes[t])
            if share < self.least_share[t]:
                return
            if t < self.n_whole:
                parts.append((-covered, t, first, end))
            else:
                out.append((self.labels[t], first, end, share))

        for begin, stop in runs.tolist():
            for start, length, state in self.automaton.matches(ids[begin:stop].tolist(), self.rules.least):
                start += begin
                for t, end_in in self.automaton.ends[state].items():
                    chain = chains.get(t)
                    fits = chain and start - chain[1] <= self.rules.gap and end_in > chain[2]
                    if chain and not fits:
                        close(t)
                    if not fits:
                        chains[t] = [start, start + length, end_in, length]
                        continue
                    new = min(length, start + length - chain[1], end_in - chain[2])
                    chain[1:] = [max(chain[1], start + length), end_in, chain[3] + max(0, new)]
        for t in list(chains):
            close(t)
        taken: list[tuple[int, int]] = []
        for covered, t, first, end in sorted(parts):
            if not any(2 * (min(end, e) - max(first, f)) > end - first for f, e in taken):
                taken.append((first, end))
                out.append((self.labels[t], first, end, min(1.0, -covered / self.sizes[t])))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        words = text.encode().translate(WORD_BYTES).split()
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        return len(words), self.base(ids), self.spans(ids)


@cache
def scanner(whole: Texts, notices: Texts, phrases: Texts, rules: Rules) -> Scanner:
    return Scanner(whole, notices, phrases, rules)


def scan(
    docs: DataFrame,
    whole: Texts = WHOLE,
    notices: Texts = NOTICES,
    phrases: Texts = PHRASES,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns doc_id, n_words, places (of phrases) and spans (of licences and notices) in word numbers.

    A null text counts as empty and has neither. Null and repeated ids pass
    through, one row each. No rows give no rows.
    """
    bound_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = pa.struct([("first", pa.int64()), ("label", pa.string())])
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(whole, notices, phrases, rules)
        for batch in batches:
            found = [own.scan(t) for t in batch.column(1).to_pylist()]
            places = [[{"first": f, "label": x} for f, x in p] for _, p, _ in found]
            spans = [[{"label": x, "first": f, "end": e, "share": s} for x, f, e, s in sp] for _, _, sp in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(places, pa.list_(place)),
                    pa.array(spans, pa.list_(span)),
                ],
                ["doc_id", "n_words", "places", "spans"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, places array<struct<first:long,label:string>>,"
        " spans array<struct<label:string,first:long,end:long,share:double>>",
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Labels and places per document; the score is the largest share of a whole licence or notice, 1 with a phrase."""
    found = scan(docs)
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    n = F.size("places").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.col("places.label"), F.col("spans.label")).alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
