"""The dealt methods themselves: list intersection, code points, radii, page classes and long pages."""

import random
import time

import numpy as np
import pytest
from basewise.llm import ann_mih, bpe_words, decontam, html_templates, simhash

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
NEAR = [ITEM.replace("echo", "extra"), " ".join(reversed(ITEM.split())), ITEM.replace(" echo", ""), ITEM + " " + ITEM.replace("alpha", "zulu")]


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST, 0])
def test_intersection_rejects_near_phrases(spark, monkeypatch, broadcast):
    """Lists alone, broadcast or shuffled, tell a phrase from its words in another order or with one changed; one index serves two benchmarks."""
    monkeypatch.setattr(decontam, "BROADCAST", broadcast)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*NEAR, f"so {ITEM}", "", None])], "doc_id long, text string")
    index = decontam.build_index(docs)
    found = decontam.search(index, spark.createDataFrame([(7, ITEM)], "item_id long, text string"), slop=None)
    assert {r.doc_id: r.n_hit for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 10, 4: 10, 5: 0, 6: 0}
    other = decontam.search(index, spark.createDataFrame([(8, "extra foxtrot"), (9, "no such words")], "item_id long, text string"), slop=None)
    assert {r.doc_id for r in other.collect() if r.n_hit} == {0}


def test_words_of_code_points():
    """Ids are the library's for characters of every block, composed or not."""
    from tokenizers import Tokenizer

    path = bpe_words.default_path()
    own, split, encode = Tokenizer.from_file(path), bpe_words.Splitter(path), bpe_words.WordEncoder(path)
    draw = random.Random(1)
    pool = [chr(k) for k in range(0x20, 0x250)] + list("–—‘’“”„ ́̈ẞİıΣσς日")
    texts = [f"a{chr(k)}B c{chr(k)} {chr(k)}1" for k in range(0x110000) if (k < 0x3100 or k % 37 == 0 or k in (0x558, 0xC5C, 0x1C89, 0xA7CB)) and not 0xD800 <= k < 0xE000]
    texts += ["".join(draw.choices(pool, k=30)) for _ in range(5000)] + ["x" * 50_000, "<|endoftext|>a<|startoftext|>"]
    for text, want in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        got = [i for ids in encode([w for c in bpe_words.chunks(text) for w in split(c)]) for i in ids]
        assert got == want.ids, text[:50]


@pytest.mark.parametrize(("bits", "paired"), [(1, 4), (2, 4), (3, 4), (3, 48)])
def test_links_of_any_radius(spark, bits, paired):
    draw = random.Random(3)
    fps = set()
    for _ in range(4):
        base = draw.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << (draw.randrange(64) if draw.random() < 0.5 else draw.randrange(12))
            fps.add(x)
    values = np.array(sorted(fps), np.uint64)
    far = np.bitwise_count(values[:, None] ^ values)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far <= bits)), strict=True) if i < j}
    df = spark.createDataFrame([(int(x), k) for k, x in enumerate(values.view(np.int64))], "fp long, rep long")
    assert {tuple(r) for r in simhash.fingerprint_links(df, bits, paired).collect()} == want


def test_split_holds_the_radius():
    """Codes within the radius agree in some substring up to its reach, for every split."""
    draw = np.random.default_rng(5)
    for parts in (1, 2, 4, 8, 16):
        for radius in (0, 3, 9, 30):
            split = ann_mih.substrings(64, radius, parts)
            for _ in range(200):
                z = sum(1 << int(b) for b in draw.choice(64, radius, replace=False))
                assert any((z >> a & (1 << w) - 1).bit_count() <= reach for a, w, reach in split)


def test_page_classes():
    text = lambda page: html_templates.Page(page).text(set())
    assert text('<article><p class="share-price">Price</p><div class="social-science">Soc</div><div class="site-header">no</div><div class="cookie-notice">no</div></article>') == "Price Soc"
    assert text('<div class="header-image-post">Yes</div><div class="main-nav">no</div><ul class="related-posts"><li>no</ul>') == "Yes"


@pytest.mark.parametrize("page", ["<blockquote>" * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<article>" * 20_000, "<li><ul>" + "<i>" * 20_000 + "<li>" * 20_000])
def test_pages_are_read_in_linear_time(page):
    began = time.time()
    assert html_templates.Page(page).text(set()) == ""
    assert time.time() - began < 10
