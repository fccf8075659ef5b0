"""Near copies against brute force over all pairs of shingle sets."""

import corpus_pipeline
import pytest
import xxhash
from basewise.llm import near_copies

SF = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def print_of(grams):
    """The SimHash of distinct shingles."""
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum((sum(x >> k & 1 for x in h) * 2 > len(h)) << k for k in range(64))


def similar(a, b, x, y):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) or bool(a and b and (x ^ y).bit_count() <= near_copies.BITS)


def components(texts):
    """For each text, the smallest place in the list that a chain of similar texts reaches."""
    sets = [grams(t) for t in texts]
    fps = [print_of(g) for g in sets]
    out = [None] * len(texts)
    for k in range(len(texts)):
        todo = [k] if out[k] is None else []
        while todo:
            x = todo.pop()
            if out[x] is None:
                out[x] = k
                todo += [y for y in range(len(texts)) if out[y] is None and similar(sets[x], sets[y], fps[x], fps[y])]
    return out


def made(n=60):
    """One base text with copies of one edit each, of which not all are similar to each other; others that share a passage; odd rows."""
    base = [f"w{k}" for k in range(50)]
    out = [" ".join(base[:k] + ["edited", str(k)] + base[k + 1 :]) for k in range(5, 45)] + [" ".join(base)]
    out += [" ".join(base[:25] + [f"own{k}-{j}" for j in range(25)]) for k in range(n)]
    return [*out, "", None, "a b", "A  b", "a c", "  "]


@pytest.mark.parametrize("paired", [near_copies.PAIRED, 1])
def test_groups(spark, monkeypatch, paired):
    """Small and large buckets give the groups of brute force."""
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    texts = made() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.id: r.grp for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components(texts)
    first = {}
    assert [first.setdefault(got[k], k) for k in range(len(texts))] == want


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_across(spark, block):
    """Members of one bucket in different components are all compared, whatever the blocks."""
    from pyspark.sql import functions as F

    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + ["edited", str(k)] + base[k + 1 :]) for k in range(5, 100, 5)] + [" ".join(base[:60] + [f"own{k}-{j}" for j in range(60)]) for k in range(20)]
    sets = near_copies.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("id", "node", "held").cache()
    placed = sets.select(F.lit(1).cast("long").alias("h"), "node", (F.col("id") % 3).alias("component"))
    got = {frozenset(r) for r in near_copies._across(placed, sets.select("node", "held"), block).collect()}
    rows = [(r.node, r.id % 3, set(r.held)) for r in sets.collect()]
    want = {frozenset((a, b)) for a, i, x in rows for b, j, y in rows if a < b and i != j and 5 * len(x & y) >= 4 * len(x | y)}
    assert want and want <= got and len(got) < len(rows) * (len(rows) - 1) // 4


def test_stage_drops_near_copies(spark):
    """Of a pair of sf0.01 with a similarity of 0.8 or more that SimHash tells apart, one stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id in (2, 56, 709, 944, 3)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [2, 3, 709]


def test_sets_are_read_in_small_pieces(spark, monkeypatch):
    """The shingle sets of one large file are many row groups, of which a reader holds one at a time."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    sizes = {}

    def spied(df, name, *args, real=near_copies.stash, **more):
        out = real(df, name, *args, **more)
        for path in out.inputFiles():
            meta = pq.read_metadata(urlparse(path).path)
            groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
            sizes.setdefault(name, []).append([sum(g.column(c).total_uncompressed_size for c in range(g.num_columns)) for g in groups])
        return out

    monkeypatch.setattr(near_copies, "stash", spied)
    docs = spark.range(0, 2_000, 1, 1).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 800), x -> concat('w', id, '-', x))) text")
    assert near_copies.near_copy_groups(docs).select("grp").distinct().count() == 2_000
    (groups,) = sizes["near-sets"]
    assert sum(groups) > 12_000_000 and max(groups) < 8 << 20


def test_tables_without_links_need_no_python(spark):
    """Links and components of tables that Spark makes itself start no Python workers, whether there are links or not."""
    from basewise.llm import components, simhash

    for fps in (spark.range(0), spark.range(3)):
        links = simhash.fingerprint_links(fps.selectExpr("id << 20 fp", "id rep"))
        groups = components.connected_components(links, "a", "b")
        assert (links.count() > 0) == (groups.count() > 0) == (fps.count() > 0)
        assert not any("ExistingRDD" in df._jdf.queryExecution().toString() for df in (links, groups))


def test_driver_collects_between_steps(spark, monkeypatch):
    """Garbage of a step's plans is given back before the next step, not only at the end: the driver's heap grows by it."""
    calls = []
    monkeypatch.setattr(near_copies, "released", calls.append)
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    groups = {r.id: r.grp for r in near_copies.near_copy_groups(df).collect()}
    assert groups[1] == groups[2] != groups[3] and len(calls) >= 3
