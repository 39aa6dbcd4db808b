"""Lexical search, line quality and the manifest against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import ascii_lower

from tabscope.llm import lexical, lines, merkle

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def plain_search(docs: list[tuple], items: list[tuple], top: int = 10) -> set[tuple]:
    words = [(d, Counter(terms(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n_docs, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = set()
    for item, text in items:
        found = []
        for doc, c in words:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = 0
            for t in set(terms(text)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out |= {(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)}
    return out


def searched(spark, docs, items, **more) -> set[tuple]:
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    out = lexical.ranked_search(left, right, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()}


def corpus(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "中文", "x9", "Ab"]
    text = lambda most: " ".join(r.choices(vocabulary, [1 / (1 + k) for k in range(64)], k=r.randint(1, most)))
    docs = [(k, text(80)) for k in range(n)] + [(n + k, "w1 w2, w3-w50") for k in range(15)]
    docs += [(n + 20, None), (n + 21, ""), (n + 22, " .,; "), (None, "w40 w41 w42"), (n + 23, "w40 w41 w42 " * 3000)]
    items = [(k, text(12)) for k in range(30)] + [(40, None), (41, "..."), (42, "unknownword"), (43, "W50, ab"), (None, "w40 w41")]
    return docs, items


def test_lexical_search(spark):
    docs, items = corpus(600, 1)
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_lexical_search_in_blocks_and_small_trees(spark, monkeypatch):
    """Several blocks of items, rows of few documents, and trees with a leaf or two give the same."""
    docs, items = corpus(300, 2)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(lexical, "TREE_DOCS", 40)
    monkeypatch.setattr(lexical, "CELLS", 128)
    assert searched(spark, docs, items, top=4) == plain_search(docs, items, 4)


def test_lexical_search_of_odd_tables(spark):
    docs, items = corpus(20, 3)
    assert searched(spark, [], items) == set() == searched(spark, docs, [])
    assert searched(spark, [(1, None)], items) == set() == searched(spark, docs, [(1, None)])
    # Equal items are one, each row of the documents is a document.
    twice = [(5, "w1 w2 w9")] * 3
    assert searched(spark, twice + docs, items[:2] * 2) == plain_search(twice + docs, items[:2])


def test_bounds_prune_and_lose_nothing():
    """The walk scores a part of the pairs only, where most documents are alike and one is far better."""
    rng = np.random.default_rng(4)
    vectors = [np.sort(rng.choice(40, 5, replace=False)) for _ in range(20)]
    weights = rng.integers(1, 9000, 40).astype(float)
    items = lexical.ItemTree(vectors, weights)
    assert sorted(items.order) == list(range(20))
    for level in items.levels:
        for node in range(len(level.starts) - 1):
            below = items.order[level.items[node] : level.items[node + 1]]
            own = level.terms[level.ends[node] : level.ends[node + 1]]
            assert set(own.tolist()) == {t for k in below for t in vectors[k].tolist()}
    sizes = rng.integers(1, 20, 500)
    row = {
        "docs": list(range(500)), "lengths": sizes, "ends": np.cumsum(sizes),
        "terms": np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in sizes]), "tfs": rng.integers(1, 5, sizes.sum()),
    }
    best = lexical.Best(np.zeros(20), 3)
    (tree,) = lexical.doc_trees(row, weights, 500, int(sizes.sum()))
    assert all((tree.levels[k + 1][j // lexical.FAN] >= tree.levels[k][j]).all() for k in range(len(tree.levels) - 1) for j in range(len(tree.levels[k])))
    lexical.search(tree, items, best)
    starts = np.concatenate([[0], row["ends"]])
    for place, k in enumerate(items.order):
        best.cut(place)
        scores = []
        for d in range(500):
            at = slice(starts[d], starts[d + 1])
            m = 10 + 90 * int(sizes[d]) * 500 // int(sizes.sum())
            part = 10**9 * row["tfs"][at] // (1000 * row["tfs"][at] + 8 * m)
            scores.append((-int(sum(weights[t] * p for t, p in zip(row["terms"][at], part, strict=True) if t in vectors[k])), d))
        assert [(s, d) for s, _, d in best.found[place]] == [x for x in sorted(scores)[:3] if x[0]]


def test_forward_backward():
    """Marginals of lines and of neighbouring pairs, against sums over all labellings."""
    rng = np.random.default_rng(1)
    ends = np.array([0, 1, 5, 8])
    odds, moves = rng.normal(size=8) * 2, rng.normal(size=(2, 2))
    good, pairs = lines.forward_backward(odds, ends, moves)
    for a, b in itertools.pairwise(ends):
        total, want, both = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(odds[a + k] for k, x in enumerate(labels) if x) + sum(moves[x, y] for x, y in itertools.pairwise(labels)))
            total += w
            want += w * np.array(labels)
            for k, (x, y) in enumerate(itertools.pairwise(labels)):
                both[k, x, y] += w
        assert np.allclose(good[a:b], want / total) and np.allclose(pairs[a:b], both / total)


def test_line_measures():
    rows = lines.measured("One TWO three\n\none two three four\none two three four\n### ### | a".encode())
    names = list(lines.MEASURES)
    at = lambda k, name: rows[k][names.index(name)]
    assert len(rows) == 5 and at(1, "bytes") == 0 and at(0, "words") == 3
    assert at(0, "upper") == 4 / 13 and at(3, "seen") == 1.0 and at(2, "seen") == 0.0 and at(3, "repeats") == 1.0
    assert at(4, "symbols") == 7 / 11 and at(4, "twins") == 1 / 4
    own = lines.gather([b"a b c", b"", b"x\ny"])
    assert own.ends.tolist() == [0, 1, 2, 4] and own.classes.shape == (4, 3 * len(names))
    assert (own.classes[3, len(names) : 2 * len(names)] == own.classes[2, : len(names)] + lines.OWN).all()


def junk(good: bool, r: random.Random) -> str:
    word = lambda: "".join(r.choices("aeinrst", k=r.randint(2, 8))) + ("" if good else r.choice(("###", "$$$", "&&&")))
    return "\n".join(" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(r.randint(1, 6)))


def test_line_field_tells_lines_apart():
    r = random.Random(6)
    good = [k % 3 > 0 for k in range(300)]
    model = lines.fit([junk(g, r).encode() for g in good], [int(g) for g in good])
    mixed = lines.gather([(junk(True, r) + "\n" + junk(False, r)).encode(), junk(True, r).encode()])
    marginals, _ = lines.forward_backward(model.odds(mixed), mixed.ends, model.moves)
    assert marginals[0] > 0.5 > marginals[mixed.ends[1] - 1] and (marginals[mixed.ends[1] :] > 0.9).all()


def test_quality_of_odd_tables(spark):
    docs = [(1, "a b\nc", 0), (2, None, 0), (None, "x " * 40_000 + "\n" * 500, 0), (2, "", 0), (2, "", 0), (4, "junk ### ###", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in docs}
    for known in ([], [(1, 1, 0), (None, 0, 0), (2, None, 0)], [(1, 1, 0), (4, 0, 0), (4, 0, 0), (2, 0, 0), (2, 1, 0), (77, 0, 0)]):
        rows = lines.quality_scores(table, spark.createDataFrame(known, labels)).collect()
        assert len(rows) == 6
        for row in rows:
            assert row.held_out == held[row.doc_id] and 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    assert lines.quality_scores(table.limit(0), spark.createDataFrame([], labels)).count() == 0


def test_held_out_labels_train_nothing(spark):
    r = random.Random(7)
    ids = range(400)
    docs = spark.createDataFrame([(k, junk(k % 2 > 0, r)) for k in ids], "doc_id long, text string")
    right = [(k, k % 2) for k in ids]
    wrong = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in right]
    a, b = (lines.fit_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (right, wrong))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)


@needs_tables
def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = lines.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.predicted for r in rows if r.quality == 1)


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def framed(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def plain_manifest(rows: list[dict]) -> Counter:
    leaf = lambda r, **new: digest(*(framed((r | new)[f]) for f in merkle.FIELDS))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = [sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in sources]
    trees = [plain_tree([leaf(r) for r in group]) for group in own]
    top = plain_tree([t[-1][0] for t in trees])
    out: Counter = Counter()
    for s, group in enumerate(own):
        for i, r in enumerate(group):
            path = plain_path(trees[s], i) + plain_path(top, s)
            folded = trees[s][0][i]
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                folded = leaf(r, text=r["text"].replace("\n", ""))
            for a, b in path:
                folded = digest(a, folded, b)
            proof = digest(*(a + b for a, b in path))
            out[r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def documents(n_hot: int) -> list[dict]:
    r = random.Random(8)
    rows = [{"doc_id": 3 * k, "source": "hot", "lang": "é", "n_chars": k, "text": r.choice(["a\nb", "", "long\n" * 50, None])} for k in range(n_hot)]
    rows += [{"doc_id": k, "source": f"s{k % 7}", "lang": None, "n_chars": None, "text": "x\n"} for k in range(60)]
    rows += [{"doc_id": None, "source": None, "lang": None, "n_chars": 1, "text": "n"}, {"doc_id": 5, "source": "", "lang": "", "n_chars": 0, "text": ""}]
    rows += [dict(rows[1])] * 3 + [{"doc_id": None, "source": "hot", "lang": "de", "n_chars": None, "text": None}] * 2
    return rows


@pytest.mark.parametrize("n_hot", [1, 90, 800])
def test_manifest(spark, n_hot):
    rows = documents(n_hot)
    table = spark.createDataFrame([(*(r[f] for f in ("doc_id", "source", "lang", "n_chars", "text")), "x", 1) for r in rows], COLUMNS)
    out = merkle.manifest_report(table.repartition(5))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.columns == names
    assert Counter(tuple(r) for r in out.collect()) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_manifest_of_one_source(spark, n):
    rows = [{"doc_id": k, "source": "s", "lang": "l", "n_chars": 2, "text": "a\n"} for k in range(n)]
    table = spark.createDataFrame([tuple(r[f] for f in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows], COLUMNS[: COLUMNS.index(", leaf")])
    assert Counter(tuple(r) for r in merkle.manifest_report(table).collect()) == plain_manifest(rows)


def test_stored_manifest_proves_single_leaves(spark, tmp_path):
    """A manifest read again answers a few requests; a digest of other contents, or a rank that isn't there, fails."""
    rows = documents(800)
    table = spark.createDataFrame([tuple(r[f] for f in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows], COLUMNS[: COLUMNS.index(", leaf")])
    built, _ = merkle.build(table, str(tmp_path / "manifest"))
    again = merkle.load(spark, built.path)
    assert again.root == built.root and len(again.segments) == len(built.segments) == 2
    tree, size = again.trees.filter("source = 'hot'").select("tree", "size").first()
    asked = [(tree, size, 700, 1, None, None), (tree, size, 3, 2, None, digest("other")), (tree, size, size + 5, 3, None, None)]
    requests = spark.createDataFrame(asked, "tree long, size long, rank long, doc_id long, leaf string, presented string")
    found = {r.doc_id: r for r in merkle.prove(again, merkle.in_blocks(requests)).collect()}
    assert found[1].verified and found[1].folded_root == built.root
    assert not found[2].verified and found[2].leaf is not None
    assert found[3].leaf is None and not found[3].verified


def test_segments_fold_and_walk():
    leaves = [digest(str(k)) for k in range(100)]
    top, nodes = merkle.fold(leaves, 5)
    records = dict(nodes)
    assert [merkle.levels_of(n) for n in (1, 2, 3, 4, 9, 10, 243, 244)] == [0, 1, 1, 2, 2, 3, 5, 6]
    for place in range(243):
        found = merkle.walk(top, records, 5, place)
        if place >= 100:
            assert found is None
            continue
        node, steps = found
        assert node == leaves[place]
        for a, b in reversed(steps):
            node = digest(a, node, b)
        assert node == top
