"""Each operator against a brute-force version, on sf0.01 and on hand-made rows with nulls, empty and long texts and repeats."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from basewise.llm import ann_mih, bpe_words, decontam, lang_id, license_scan, simhash, url_filter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "lorem MIT license ipsum dolor " * 9_000
EDGE = [
    (9_000_000, None),
    (9_000_001, ""),
    (9_000_002, "MIT License, the mit  LICENSE; Permission is hereby granted, free of charge to any persn obtaining"),
    (9_000_003, "MIT License, the mit  LICENSE; Permission is hereby granted, free of charge to any persn obtaining"),
    (9_000_004, LONG),
    (9_000_005, "ÀÉ ß Σίσυφος ΣΣ <|endoftext|> I'm don't 42   é naïve 日本語"),
    (9_000_006, "   \t\n "),
    (9_000_007, "!!! ??? 123"),
]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    edge = spark.createDataFrame([(i, t, None, None) for i, t in EDGE], "doc_id long, text string, lang string, source string")
    clash = {c: F.lit("x") for c in ("id", "n", "term", "word", "words", "key", "score", "rep", "fp", "item")}
    return real.union(edge).withColumns(clash).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def benchmark(spark):
    short = spark.createDataFrame([(900, "the"), (901, None), (902, "!!")], "item_id long, text string")
    return spark.read.parquet(f"{SF}/benchmark.parquet").union(short)


def test_license(docs, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in license_scan.op1_query(docs).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = WORD.findall(lower(text))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[9_000_003].n_notices >= 1


def test_license_spans(spark):
    """One edit in a notice is found with its span; the span is in bytes of the text."""
    text = "é Licensed   under the Apache Licence, Version 2.0"
    (r,) = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    (s,) = [s for s in r.spans if s.label == "apache"]
    assert text.encode()[s.start : s.stop].decode() == "Licensed   under the Apache Licence, Version" and s.edits == 1


def test_nearest(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = len(table.first().embedding)
    odd = [(10_000, None), (10_050, [0.0] * size), (10_100, [float("nan")] * size), (10_150, [None] * size), (10_151, [1.0] * size), (10_200, [1.0] * size)]
    table = table.union(spark.createDataFrame(odd, table.schema))
    rows = {r.vec_id: np.array(r.embedding) for r in table.collect() if r.vec_id not in (10_000, 10_050, 10_100, 10_150)}
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    norm = np.sqrt((m * m).sum(1))
    got = defaultdict(list)
    for r in ann_mih.op2_query(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        cos = m @ rows[q] / (norm * np.sqrt(rows[q] @ rows[q]))
        order = [k for k in np.lexsort((ids, -cos)) if ids[k] != q][:5]
        hits += len({ids[k] for k in order} & {i for i, _ in found})
        assert len(found) == 5 and all(abs(s - cos[np.searchsorted(ids, i)]) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert ann_mih.op2_query(table.limit(0)).count() == 0


def test_language(docs, texts):
    judged = lang_id.op4_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(judged) == len(texts)
    held = [r for r in judged if r.held_out and r.lang]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) > 0.9 * len(held)
    by = {r.doc_id: r for r in judged}
    assert {by[9_000_000 + k].lang_pred for k in (0, 1, 6, 7)} == {"und"}
    assert all(0 <= r.score <= 1 for r in judged)
    assert lang_id.op4_query(docs.limit(0)).count() == 0


def test_decontamination(docs, texts, benchmark):
    windows = defaultdict(set)
    for r in benchmark.collect():
        w = WORD.findall(lower(r.text))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in decontam.op6_query(docs, benchmark).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        w = WORD.findall(lower(text))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[g]
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        assert tuple(got[i])[1:] == want, i


def test_proximity(spark):
    """An inserted word breaks a phrase, not its proximity."""
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    docs = spark.createDataFrame([(1, item), (2, item.replace("echo", "echo extra")), (3, "alpha bravo")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.near_items) for r in decontam.decontaminate(docs, items).collect()}
    assert got[1] == (10, ["7"], ["7"]) and got[2] == (0, [], ["7"]) and got[3] == (0, [], [])


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(a[:, None] ^ a) <= 2
    comp = dict.fromkeys(ids)
    for k, i in enumerate(ids):
        if comp[i] is None:
            stack = [k]
            while stack:
                x = stack.pop()
                if comp[ids[x]] is None:
                    comp[ids[x]] = i
                    stack += np.flatnonzero(near[x]).tolist()
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op7_query(docs).collect()}
    assert got == {i: (fps[i], comp[i]) for i in ids}


@pytest.mark.parametrize("paired", [2, 48])
@pytest.mark.parametrize("bits", [1, 2])
def test_simhash_links_in_large_buckets(spark, monkeypatch, paired, bits):
    """The linear way for large buckets gives the components that pairs give."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 4)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (40, 2))})
    links = simhash.fingerprint_links(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long"), bits).collect()
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    want = list(range(len(fps)))
    root2, root = [find(k) for k in range(len(fps))], want
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= bits:
                root[max(find(x), find(y))] = min(find(x), find(y))
    assert root2 == [find(k) for k in range(len(fps))]


def test_urls(spark):
    urls = ["http://a.example.com/en/3?x#y", "https://EXAMPLE.com/en/77", "http://b.example.net/de/81", "http://example.net/de/9", "http://x.org/es/", "ftp://h", None, "no scheme", "", "http://notcom/en/1"]
    real = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame(list(enumerate(urls + real)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.op8_query(pages).collect()}
    for i, url in enumerate(urls + real):
        m = re.match(r"[^\0]*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(d + p), d + p, v) for v, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    plain = [(r.verdict == "block", "spam" in r.host or "pills" in r.host or "casino" in r.host) for r in got.values() if not r.rule and r.host]
    assert sum(a == b for a, b in plain) > 0.9 * len(plain)
    assert url_filter.op8_query(pages.limit(0)).count() == 0


def test_url_rules_of_the_contract(spark):
    """Every rule's text and verdict, on its host and a subdomain, whatever the model says of the words; the longest wins."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(rule, word, f"http://{sub}{host}/{path}{word}") for rule in want for host, path in [rule.split("/", 1)] for sub in ("", "a.") for word in ("casino", "news")]
    pages = spark.createDataFrame([(k, url) for k, (_, _, url) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op8_query(pages).collect()}
    assert got == {k: (rule, want[rule]) for k, (rule, _, _) in enumerate(rows)}


@pytest.mark.parametrize("frequent", [bpe_words.FREQUENT, 100])
def test_bpe(spark, docs, texts, frequent):
    """Ids and decoded texts are the library's, whether words come back by broadcast or by join."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe_words.default_path())
    got = {r.id: r for r in bpe_words.encode(docs, bpe_words.default_path(), frequent=frequent, digest=True).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = own.encode(text or "", add_special_tokens=False).ids
        said = own.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, i


def test_bpe_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe_words.default_path())
    some = docs.filter("doc_id < 50 or doc_id >= 9000000")
    back = {r.id: r.text for r in bpe_words.decode(bpe_words.encode(some, bpe_words.default_path()), bpe_words.default_path()).collect()}
    for i, said in back.items():
        assert said == own.decode(own.encode(texts[i] or "", add_special_tokens=False).ids, skip_special_tokens=False)
