"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for each new word. A sequence of tokens is
the BPE encoding exactly if each two neighbours are compatible, which is tested
for all neighbours of a batch at once. Only words with an incompatible pair are
merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import bound_arrow_batches, without_gc

#: White space by the Unicode property, which Python's own class exceeds.
SPACE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern that cuts a text into words before merging.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NEVER = np.int64(1 << 40)
NONE = 1 << 40
SHORT_WORD = 96
#: Further proposals for words whose first one fails.
ATTEMPTS = 3
BETWEEN = "\u0100"
KNOWN_WORDS = 600_000


def byte_names() -> dict[str, int]:
    """Vocabulary files write each byte as one visible character: itself, or the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if b not in set(visible))
    return names | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A vocabulary with tokens numbered by age: 0-255 the bytes, then the merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, names = spec["model"]["vocab"], byte_names()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        age = dict(names)
        self.left = np.arange(256 + len(pairs), dtype=np.int64)
        self.right = self.left.copy()
        texts = [bytes([b]) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs, 256):
            self.left[k], self.right[k] = age[a], age[b]
            self.merged.setdefault((age[a], age[b]), k)
            age.setdefault(a + b, k)
            texts.append(texts[age[a]] + texts[age[b]])
        self.ids = np.zeros(len(texts), dtype="<u4")
        for name, k in age.items():
            self.ids[k] = vocab[name]
        keys = np.array([(a << 20) | b for a, b in self.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.joined = np.array(list(self.merged.values()), dtype=np.int64)[order]
        self.special = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        self.bytes_of = {int(i): texts[k] for k, i in enumerate(self.ids)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        # Only tokens that merging can make may be proposed.
        self.known = {t: k for k, t in enumerate(texts) if k < 256 or self.merge(t) == [k]}
        self.longest = max(map(len, self.known))
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.lengths = self.sizes.tolist()
        # The longest known token that a token begins with, apart from itself; -1 for single bytes.
        self.shorter = np.full(len(texts), -1, dtype=np.int64)
        for k, t in enumerate(texts):
            for n in range(len(t) - 1, 0, -1):
                if (begin := self.known.get(t[:n])) is not None:
                    self.shorter[k] = begin
                    break
        # Finds the longest known token at each place, of many words in one go.
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in self.known.items():
            self.finder.add_word(t.decode("latin-1"), k)
        self.finder.make_automaton()

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the oldest pair, and of equal ones the leftmost."""
        if len(word) > SHORT_WORD:
            return self.merge_long(word)
        part, get = list(word), self.merged.get
        pairs = [get(p, NONE) for p in zip(part, part[1:], strict=False)]
        while pairs and (m := min(pairs)) < NONE:
            i = pairs.index(m)
            part[i : i + 2] = [m]
            del pairs[i]
            if i:
                pairs[i - 1] = get((part[i - 1], m), NONE)
            if i < len(pairs):
                pairs[i] = get((m, part[i + 1]), NONE)
        return part

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a queue, whose cost doesn't grow with the square of the length."""
        part: list[int | None] = list(word)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, i, part[i], part[i + 1]) for i in range(n - 1) if (m := self.merged.get((part[i], part[i + 1])))]
        heapq.heapify(queue)
        while queue:
            m, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = m, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if new := self.merged.get((m, part[after[j]])):
                    heapq.heappush(queue, (new, i, m, part[after[j]]))
            if before[i] >= 0 and (new := self.merged.get((part[before[i]], m))):
                heapq.heappush(queue, (new, before[i], part[before[i]], m))
        return [p for p in part if p is not None]

    def propose(self, word: bytes) -> list[int]:
        """The longest known token at each place."""
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (token := self.known.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proposed tokens of all words in a row, and their number by word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # No token has the character between two words.
        found = list(self.finder.iter_long(BETWEEN.join([w.decode("latin-1") for w in words])))
        pairs = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=2 * len(found)).reshape(-1, 2)
        flat, ends = pairs[:, 1], pairs[:, 0] + 1
        word_ends = np.cumsum(lengths + 1) - 1
        of = np.searchsorted(word_ends, ends)
        # Tokens side by side fill every word, or else each word is cut by itself.
        if np.array_equal(np.cumsum(self.sizes[flat]) + of, ends) and self.sizes[flat].sum() == lengths.sum():
            return flat, np.bincount(of, minlength=len(words))
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        return np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(sizes.sum())), sizes

    def first_clash(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with neighbours that aren't compatible, and where in ``flat`` the first such pair begins."""
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), dtype=bool)
        inner[ends[ends < len(flat)]] = False
        second = np.flatnonzero(inner)[1:] if len(flat) else np.zeros(0, dtype=np.int64)
        pairs = (flat[second - 1] << 20) | flat[second]
        kinds, back = np.unique(pairs, return_inverse=True)
        clash = second[~self.compatible(kinds >> 20, kinds & ((1 << 20) - 1))[back]]
        words, first = np.unique(np.searchsorted(ends, clash, side="right"), return_index=True)
        return words, clash[first] - 1

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves the border between them alone.

        Merges are undone from the youngest on, always of the token at the border
        that is younger. If the parts that then meet could have merged before
        what was undone, BPE would have crossed the border.
        """
        ok = np.ones(len(left), dtype=bool)
        limit = np.full(len(left), NEVER)
        left, right, live = left.copy(), right.copy(), np.arange(len(left))
        while len(live):
            a, b = left[live], right[live]
            key = (a << 20) | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.joined[at], NEVER) < limit[live]
            ok[live[across]] = False
            go = ~across & (np.maximum(a, b) >= 256)
            live, a, b = live[go], a[go], b[go]
            undo_left = a > b
            limit[live] = np.where(undo_left, a, b + 1)
            left[live] = np.where(undo_left, self.right[a], a)
            right[live] = np.where(undo_left, b, self.left[b])
        return ok

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers.

        Where a proposal fails, its first token that clashes with the next is
        proposed once more as its longest shorter beginning, and the rest of the
        word anew, a few times. Words that still fail are merged.
        """
        out: list[bytes] = [b""] * len(words)
        # Of each open word: what it is, the bytes and tokens that stand already, and the rest.
        open_words, heads, rests = list(range(len(words))), [()] * len(words), words
        for attempt in range(ATTEMPTS + 1):
            if not open_words:
                return out
            flat, sizes = self.propose_all(rests)
            if attempt:
                before = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
                stands = np.fromiter(chain.from_iterable(heads), dtype=np.int64, count=int(before.sum()))
                total, starts = before + sizes, np.cumsum(before + sizes) - before - sizes
                both = np.empty(len(flat) + len(stands), dtype=np.int64)
                of_stands = np.repeat(starts - (np.cumsum(before) - before), before) + np.arange(len(stands))
                of_flat = np.repeat(starts + before - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
                both[of_stands], both[of_flat] = stands, flat
                flat, sizes = both, total
            failed, clash = self.first_clash(flat, sizes)
            ends = np.cumsum(sizes)
            ids = self.ids[flat].tobytes()
            fine = np.ones(len(open_words), dtype=bool)
            fine[failed] = False
            for k in np.flatnonzero(fine).tolist():
                out[open_words[k]] = ids[4 * int(ends[k] - sizes[k]) : 4 * int(ends[k])]
            todo, kept_heads, kept_rests = [], [], []
            shorter = self.shorter[flat[clash]]
            for k, at, short in zip(failed.tolist(), clash.tolist(), shorter.tolist(), strict=True):
                word = words[open_words[k]]
                if short < 0 or attempt == ATTEMPTS:
                    out[open_words[k]] = self.ids[self.merge(word)].tobytes()
                    continue
                first = int(ends[k] - sizes[k])
                head = (*flat[first:at].tolist(), short)
                todo.append(open_words[k])
                kept_heads.append(head)
                kept_rests.append(word[sum(map(self.lengths.__getitem__, head)) :])
            open_words, heads, rests = todo, kept_heads, kept_rests
        return out


class Encoder:
    """Encodes and decodes texts, and remembers the words it has met, up to a fixed number."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        specials = sorted(self.merges.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def pieces(self, text: str) -> list[str]:
        """Keys of the text's parts that can be encoded apart.

        A key names the part after a blank, unless it begins with a line end.
        One blank before a key stands for none, and two mark a single word.
        Words can be cut at blanks where these stand alone.
        """
        runs, blanks = text.split(), text.count(" ") + text.count("\n")
        # Other white space, or two blanks side by side or at an end, breaks one of these.
        if len(runs) != blanks + 1 or sum(map(len, runs)) + blanks != len(text):
            return ["  " + w for w in WORDS.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return [" " + first, *rest]

    def cut_key(self, key: str) -> list[str]:
        """The words of a key's part."""
        if key.isalpha():
            return [" " + key]
        if key[-1] in ",." and key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
        if key[:2] == "  ":
            return [key[2:]]
        return WORDS.findall(key if key[0] == "\n" else key[1:] if key[0] == " " else " " + key)

    def learn(self, keys: set[str]) -> None:
        parts = {key: self.cut_key(key) for key in keys}
        new = list({w for p in parts.values() for w in p}.difference(self.words))
        self.words.update(zip(new, self.merges.encode_words([w.encode() for w in new]), strict=True))
        get = self.words.__getitem__
        for key, p in parts.items():
            self.seen[key] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.split(t) if self.cut else [t] for t in texts]
        split = [[self.pieces(p) if k % 2 == 0 else p for k, p in enumerate(parts)] for parts in cut]
        wanted = {key for parts in split for p in parts[::2] for key in p}
        new = wanted.difference(self.seen)
        if len(self.seen) + len(new) > KNOWN_WORDS:
            self.seen.clear()
            self.words.clear()
            new = wanted
        if new:
            self.learn(new)
        get = self.seen.__getitem__
        special = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.merges.special.items()}
        return [
            b"".join(b"".join(map(get, p)) if k % 2 == 0 else special[p] for k, p in enumerate(parts)) for parts in split
        ]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.merges.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ids (little-endian unsigned 32-bit numbers), decoded.

    A null text counts as empty and has no ids. Strings of special tokens in a
    text become those tokens. Null and repeated ids pass through, one row each.
    """
    bound_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            with without_gc():
                ids = own.encode(batch.column(1).to_pylist())
                decoded = [own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def bpe_report(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, per document."""
    return encode_decode(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
