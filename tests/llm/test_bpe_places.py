"""Codes of many texts at a time."""

import random
import re

import pyarrow as pa
from basewise.llm import bpe_words

ODD = ["", " ", "a", "A b", "é\xa0ü", "x\x85y", "　", "a\x1cb", "\x0b\x0c", "[UNK] x", "[CLS]", "zzqq", "Zzqq, zzqq.", "don't", "a1b2", "\x00", "中文 字", "🙂 a", "the", "of "]


def test_places_of_many_texts():
    """All texts of a batch are coded together, each distinct chunk split once, and each text as on its own."""
    rng, path = random.Random(5), bpe_words.default_path()
    split = bpe_words.Splitter(path)
    texts = ["".join(rng.choice(ODD) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 30))) for _ in range(400)] + ["", " \n"]
    words = [[w for c in bpe_words.chunks(t) for w in split(c)] for t in texts]
    code_of = {w: k.to_bytes(4, "little") for k, w in enumerate(sorted({w for x in words for w in x})[::2])}
    place, calls = bpe_words.Places(code_of, path), []
    place.split = lambda chunk: calls.append(chunk) or split(chunk)
    place.split.apart = split.apart
    rare = [sorted({w for w in x if w not in code_of}) for x in words]
    want = [b"".join(code_of.get(w) or (len(code_of) + own.index(w)).to_bytes(4, "little") for w in x) for x, own in zip(words, rare, strict=True)]
    batch = pa.array(["the", *texts], pa.string()).slice(1)
    assert place.rare(batch) == rare
    assert place(batch) == want
    assert len(calls) <= 2 * sum(max(1, len(bpe_words.chunks(c))) for c in {c for t in texts for c in re.split("[ \t-\r]+", t)})
    assert place(batch.slice(0, 0)) == place.rare(batch.slice(0, 0)) == []
