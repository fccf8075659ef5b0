"""Merkle manifests against trees built on one list."""

import hashlib
import random
import zlib

import pytest
from basewise.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    """The root, and of every leaf the others of its runs, from below."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((i % arity, [level[j] for j in range(i // arity * arity, min((i // arity + 1) * arity, len(level))) if j != i]))
        level, at = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [i // arity for i in at]
    return level[0], paths


def brute(rows, arity):
    """rows (doc_id, source, lang, n_chars, text) to sorted results of op12."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], arity) for s in order]
    root, above = tree([b[0] for b in built], arity)
    out = []
    for s, (sub, paths), up in zip(order, built, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), paths, strict=True):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = h(*map(field, (*r[:4], text)))
            for place, others in path + up:
                folded = h(*others[:place], folded, *others[place:])
            out.append((r[0], leaf, sub, root, h(*(x for _, o in path + up for x in o)), folded, folded == root))
    return sorted(out, key=str)


def rows(n, sources, seed=3):
    rng = random.Random(seed)
    out = [(k, f"s{int(rng.random() ** 3 * sources)}", "en", k % 7, rng.choice(["a\nb", "é", "x", "\n", ""])) for k in range(n)]
    return out + [(None, None, None, None, None), (None, "é", None, 3, "y\n"), (4, "", "de", None, None), (5, None, "", 1, "t"), (5, None, "", 1, "t"), (5, None, "", 1, "u"), (9, "~", "x", -1, "z" * 5000)]


@pytest.mark.parametrize(("n", "sources", "part", "arity"), [(0, 1, 4, 3), (30, 1, 4, 3), (243, 1, 10, 3), (300, 6, 7, 3), (300, 250, 16, 3), (100, 3, 1, 2), (300, 6, 1 << 14, 3)])
def test_trees(spark, monkeypatch, n, sources, part, arity):
    monkeypatch.setattr(merkle, "FAN", 3)
    monkeypatch.setattr(merkle.manifest, "__defaults__", ("doc_id", "source", None, arity, part))
    own = rows(n, sources)
    docs = spark.createDataFrame(own, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"grp": F.lit(1), "id": F.lit("a"), "leaf": F.lit("b"), "part": F.lit(2), "path": F.lit(0)})
    assert sorted((tuple(r) for r in merkle.op12_query(docs).collect()), key=str) == brute(own, arity)


def test_one_leaf_and_none(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.op12_query(spark.createDataFrame([], kind)).count() == 0
    (r,) = merkle.op12_query(spark.createDataFrame([(1, "a", "en", 1, "x")], kind)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h() and r.verified


def test_adding_forests_in_any_order():
    """The monoid: joining partial forests in different orders and groupings leaves the same forest."""
    n, rng = 40, random.Random(5)
    sizes, leaves = merkle.levels(n, 3), [h(str(k)) for k in range(n)]
    root, _ = tree(leaves, 3)
    for _ in range(20):
        parts = [merkle.add({(0, k): leaves[k] for k in own}, sizes, 3) for own in (lambda p: [p[a::4] for a in range(4)])(rng.sample(range(n), n))]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop()
            parts.append(merkle.add(a | b, sizes, 3))
        assert parts == [{(len(sizes) - 1, 0): root}]
