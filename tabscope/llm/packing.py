"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document goes to the
window that it fits best; when none fits and no more may be opened, the fullest
is emitted. Windows still open at a partition's end are merged with those of
other partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from struct import Struct

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.bpe import byte_names
from tabscope.llm.common import bound_arrow_batches, without_gc
from tabscope.session import stage_table

LENGTH = 4096
OPEN_WINDOWS = 32
MERGED_PARTITIONS = 8
END_ID = 2
#: A window with no more room than this is emitted as it is; a larger gap is filled by cutting a document.
SPARE = LENGTH // 128
KNOWN_WORDS = 600_000
#: Blanks to Python's split() that aren't white space to the tokenizer, and the start of its special tokens.
UNSAFE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Beyond Latin letters, which are lower-cased one by one and are in composed form already.
NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: A comma or full stop behind another mark belongs to the mark's piece.
MARKS = re.compile(r"(?:[^\w\s]|_)[,.]\s")
#: The tokenizer's pieces of lower-cased text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
FIRST_MERGED = 1 << 62


def not_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return NOT_LATIN.search(text) is not None


class WordIds:
    """Ids by white-space separated chunk, which this tokenizer encodes apart; remembers a fixed number of chunks.

    Latin text is lower-cased and cut here, so that only new pieces meet the
    merges. Other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.visible = {b: c for c, b in byte_names().items() if ord(c) != b}
        self.seen: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, text: str) -> list[str] | None:
        """Keys of the text's chunks; a leading blank marks one that isn't Latin. None if it can't be cut."""
        if any(x in text for x in UNSAFE):
            return None
        if not text.isascii() and not_latin(text):
            return [" " + c for c in text.split()]
        text = text.lower()
        if not MARKS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return text.split()

    def cut_key(self, key: str) -> list[str]:
        if key.isalpha():
            return [key]
        return PIECES.findall(key)

    def learn(self, keys: list[str]) -> None:
        other = [k for k in keys if k[0] == " "]
        self.seen.update(zip(other, self.fresh([k[1:] for k in other]), strict=True))
        parts = {k: self.cut_key(k) for k in keys if k[0] != " "}
        new = list({w for p in parts.values() for w in p}.difference(self.pieces))
        tokenize, visible, four = self.tokenize, self.visible, Struct("<I").pack
        for piece in new:
            # Letters and marks of ASCII are written as themselves, other bytes as visible characters.
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(visible)
            self.pieces[piece] = b"".join([four(t.id) for t in tokenize(shown)])
        get = self.pieces.__getitem__
        for key, p in parts.items():
            self.seen[key] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [self.chunks(t) for t in texts]
        wanted = set().union(*(c for c in chunks if c))
        new = wanted.difference(self.seen)
        if len(self.seen) + len(new) > KNOWN_WORDS:
            self.seen.clear()
            self.pieces.clear()
            new = wanted
        if new:
            self.learn(list(new))
        get = self.seen.__getitem__
        return [self.fresh([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, chunks, strict=True)]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass
class Piece:
    """Consecutive ids of one document; ids as little-endian 32-bit numbers."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(
            self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens
        )


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    free: int = LENGTH

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece)


class Packer:
    """Places pieces online; ``full`` gathers windows to emit, ``open`` holds at most ``most``."""

    def __init__(self, most: int = OPEN_WINDOWS, spare: int = SPARE):
        self.most, self.spare = most, spare
        self.open: list[Window] = []
        self.full: list[Window] = []

    def place(self, piece: Piece) -> None:
        while len(piece) > LENGTH:
            head, piece = piece.cut(LENGTH)
            self.full.append(Window([head], 0))
        while True:
            need = len(piece)
            best = min((w for w in self.open if w.free >= need), key=lambda w: w.free, default=None)
            if best is None and len(self.open) >= self.most:
                fullest = min(self.open, key=lambda w: w.free)
                self.open.remove(fullest)
                self.full.append(fullest)
                if fullest.free > self.spare:
                    head, piece = piece.cut(fullest.free)
                    fullest.add(head)
                continue
            if best is None:
                best = Window()
                self.open.append(best)
            best.add(piece)
            if best.free == 0:
                self.open.remove(best)
                self.full.append(best)
            return


def merged(windows: list[Window], spare: int = SPARE) -> list[Window]:
    """Open windows put together: whole ones by best fit, then the rest end to end.

    What is left at last is dealt to sequences whose lengths are powers of two,
    which need no padding.
    """
    bins: list[Window] = []
    for w in sorted(windows, key=lambda w: w.free):
        used = LENGTH - w.free
        best = min((b for b in bins if b.free >= used), key=lambda b: b.free, default=None)
        if best is None:
            bins.append(best := Window())
        for piece in w.pieces:
            best.add(piece)
    done = [b for b in bins if b.free <= spare]
    rest = [p for b in bins if b.free > spare for p in b.pieces]
    left = sum(map(len, rest))
    while left:
        size = LENGTH if left >= LENGTH else 1 << (left.bit_length() - 1)
        w, room = Window(), size
        while room:
            if len(rest[0]) > room:
                head, rest[0] = rest[0].cut(room)
            else:
                head = rest.pop(0)
            w.add(head)
            room -= len(head)
        done.append(w)
        left -= size
    return done


def fields(kind: str) -> str:
    return (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        ", part long, ids binary"
    )


def rows_of(window: Window, sequence: int, part: int | None, keep: bool) -> Iterator[tuple]:
    offset = 0
    for p in window.pieces:
        yield p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset, part, p.ids if keep else None
        offset += len(p)


def pack(docs: DataFrame, path: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in the sequences.

    A document's ids end with id 2, so a null or empty text has one token. Null
    and repeated document ids pass through. With ``keep_ids`` column ``ids``
    holds each piece's ids; otherwise only those of open windows are kept until
    the merge. Sequence ids are unique, not gapless. No rows give no rows.
    """
    bound_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()
    schema = fields(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, packer, number = word_ids(path), Packer(), part << 36
        types: list[pa.DataType] = [pa.int64()] * 8 + [pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")]
            )

        for batch in batches:
            types[0] = batch.column(0).type
            with without_gc():
                encoded = own.encode(batch.column(1).to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                packer.place(Piece(doc, 0, ids, len(ids) // 4))
            rows = []
            for w in packer.full:
                rows += rows_of(w, number, None, keep_ids)
                number += 1
            packer.full.clear()
            if rows:
                yield table(rows)
        if packer.open:
            yield table([r for k, w in enumerate(packer.open) for r in rows_of(w, number + k, part, True)])

    pieces = stage_table(narrow.mapInArrow(run, schema), "packed")

    def merge(group: pa.Table) -> pa.Table:
        windows: dict[int, Window] = {}
        ordered = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        for r in ordered:
            windows.setdefault(r["sequence_id"], Window()).add(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        first = FIRST_MERGED + (ordered[0]["part"] // MERGED_PARTITIONS << 24)
        rows = [r for k, w in enumerate(merged(list(windows.values()))) for r in rows_of(w, first + k, None, keep_ids)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), group.schema, strict=True)], schema=group.schema)

    open_pieces = pieces.filter(F.col("part").isNotNull())
    together = F.floor(F.col("part") / MERGED_PARTITIONS)
    # At most MERGED_PARTITIONS x OPEN_WINDOWS windows meet in a group.
    leftovers = open_pieces.groupBy(together.alias("_g")).applyInArrow(merge, schema)
    columns = [x.split()[0] for x in schema.split(", ") if not x.startswith("part ") and (keep_ids or not x.startswith("ids "))]
    return pieces.filter(F.col("part").isNull()).select(columns).unionByName(leftovers.select(columns))
