"""Alignment of tokenizers against one text at a time, byte by byte."""

import hashlib
import re
from collections import Counter

import pytest
from basewise.llm import align

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline \n end\n", "x▁y", "<|endoftext|> <s> </s> <unk> <0x0A>", "你好世界 " * 5, "emoji \U0001f600\U0001f468‍\U0001f469", "a b   c", "a\x1cb\x85 c", "\x00\x01 z", "naïve ﬁ ½ é", "it's we'll  they'd", "1234567 89", "a" * 3000, "!? ... --", "repeat me", "repeat me"]


def library():
    """The first tokenizer by its own library."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(align.default_paths()[0])
    own.encode_special_tokens = True
    return own


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def grouped(a, b, sa, sb):
    groups, low = [], 0
    for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
        groups.append(",".join(str(k) for k, (x, _) in zip(a, sa, strict=True) if low <= x < cut) + "|" + ",".join(str(k) for k, (x, _) in zip(b, sb, strict=True) if low <= x < cut))
        low = cut
    return groups


def brute_groups(text):
    tools = align.Tokenizers(align.default_paths()).load()
    a, b = library().encode(" " + text).ids, tools.b.encode(text)
    return grouped(a, b, spans([tools.bytes_a[k] for k in a]), spans([tools.bytes_b[k] for k in b]))


def brute(texts):
    tools, whole = align.Tokenizers(align.default_paths()).load(), library()
    found = []
    for t in texts:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tools.b.encode(t) if t else []
        pa, pb = [tools.bytes_a[k] for k in a], [tools.bytes_b[k] for k in b]
        want = (" " + (t or "")).encode()
        if not t or b"".join(pa) != want or b"".join(pb) != want:
            found.append(None)
            continue
        sa, sb = spans(pa), spans(pb)
        groups = grouped(a, b, sa, sb)
        links = [(p, q) for p, (x, y) in zip(a, sa, strict=True) for q, (u, v) in zip(b, sb, strict=True) if x < v and u < y]
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    count = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


@pytest.mark.parametrize(("fan", "chunk", "batch"), [(256, 16 << 20, 1 << 15), (2, 900, 7)])
def test_against_whole_texts(spark, monkeypatch, fan, chunk, batch):
    monkeypatch.setattr(align, "FAN", fan)
    monkeypatch.setattr(align, "BATCH", batch)
    monkeypatch.setattr(align.align, "__defaults__", ("doc_id", "text", chunk, False))
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").limit(150).collect()]
    texts = ODD + [t if t is None else t[:1500] for t in docs]
    rows = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, chunk int")
    got = {r.doc_id or 0: tuple(r)[1:] for r in align.op13_query(rows).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == want[k], (k, t)


def test_groups(spark):
    (r,) = align.align(spark.createDataFrame([(1, "two  a")], "doc_id long, text string"), align.default_paths()).collect()
    assert r.groups == ";".join(brute_groups("two  a"))


def test_white_space():
    assert align.WHITE == [chr(c) for c in range(0x110000) if re.fullmatch(r"\s", chr(c))]


def test_empty_table(spark):
    assert align.op13_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in align.op13_query(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_units_are_encoded_as_in_their_texts():
    tools = align.Tokenizers(align.default_paths()).load()
    for t in ["a b  c\td \n e", " lead and trail ", "mixed 12 34,5 (x) été 你 好", *[x for x in ODD if x and "▁" not in x]]:
        units = align.split(t)
        assert "".join(" " + u for u in units) == " " + t and units == [u[1:] for u in align.UNIT.split(" " + t)]
        a, b = tools.encode(units)
        assert sum(a, []) == library().encode(" " + t, add_special_tokens=False).ids
        assert sum(b, []) == tools.b.encode(t)
