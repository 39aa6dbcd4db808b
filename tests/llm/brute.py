"""Plain versions of the operators, written from their definitions, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def revealing(rows: list[tuple[int, str | None]]) -> dict[str, str]:
    """Terms that leave at most one bit of an entity open, by the lower bound of their share of distinct texts, and what is done."""
    z2 = 1.645**2
    own = []
    for _, text in rows:
        entities = {(k, text[s:e].lower() if k == "email" else text[s:e]) for k, s, e in personal(text)}
        own.append((text, entities, set(re.findall(r"[^\W\d_]+", (text or "").lower()))))
    n_term = Counter(t for _, _, terms in own for t in terms)
    out: dict[str, str] = {}
    for entity in {e for _, entities, _ in own for e in entities}:
        with_it = [(text, terms) for text, entities, terms in own if entity in entities]
        for term in {t for _, terms in with_it for t in terms}:
            both = [text for text, terms in with_it if term in terms]
            k = len(set(both))
            n = k + n_term[term] - len(both)
            p = k / n
            low = (p + z2 / (2 * n) - math.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
            if -math.log2(low) <= 1 and math.log2(low * len(rows) / len(with_it)) >= 1:
                action = "remove" if -math.log2(low) <= 1 / 3 else "generalise"
                out[term] = max(action, out.get(term, ""))
    return out


def term_spans(text: str | None, hidden: dict[str, str]) -> list[tuple[str, int, int]]:
    """Words that are hidden, apart from personal data."""
    base = personal(text)
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "") if m[0].lower() in hidden]
    return [("term", s, e) for s, e in words if not any(s < b and a < e for _, a, b in base)]


def repeated(rows: list[tuple[int, str | None]], window: int) -> dict[int, list[bool]]:
    """By document, which words lie in a window that also starts earlier."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = BLANKS.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[doc] = gone
    return out


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = BLANKS.findall(text)
    lines = [x for x in text.split("\n") if BLANKS.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def shingles(text: str | None, n: int) -> frozenset:
    words = BLANKS.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """By document, the size of its set and the least document that links reach."""
    sets = {doc: shingles(text, n) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {doc: (len(sets[doc]), find(doc)) for doc in docs}


def phrase_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    return len(words), [
        (k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()
    ]


def check_packing(pieces: list, ids: dict[object, bytes]) -> float:
    """Asserts that the pieces hold each id once and sequences are gapless; returns the padding's share."""
    by_doc: dict[object, list] = {}
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and 4 * p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(ids[doc][4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids[doc])
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padding += 4096 - at if at & (at - 1) else 0
    return padding / total
