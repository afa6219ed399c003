import random

import helpers as h
import pytest
import xxhash
from pyspark.sql import functions as F
from vecreduce.llm import simhash as op


def print_of(text):
    words = h.ascii_lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def components(prints, bits=2):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force(spark):
    texts = ["", None, "one", "One TWO", "a b c", "a b c d e f g", " x\ty\nz\x0bw ", "été é É ß 😀 x", h.LONG, "a a a a a a"]
    df = h.docs(spark, list(enumerate(texts)))
    got = {r.id: r.fingerprint for r in op.fingerprints(df).collect()}
    assert got == {i: signed(print_of(t)) for i, t in enumerate(texts)}


def test_hash_is_the_sql_function(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert value == signed(xxhash.xxh64_intdigest(b"a b c", 42))


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("limit", [1, 32])
def test_links_find_every_close_pair_in_ordinary_and_crowded_buckets(spark, bits, limit):
    rng = random.Random(bits)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(15):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            prints.add(x)
            base = x if rng.random() < .3 else base
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = op.links(df, bits, bucket_limit=limit)
    for a, b in h.rows(edges):
        assert a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    found = {}
    if not edges.isEmpty():
        found = {r.node: r.label for r in op.components(edges).collect()}
    want = components(prints, bits)
    groups = {}
    for p, top in zip(prints, want):
        groups.setdefault(top, set()).add(signed(p))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = dict(h.rows(op.components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_classes_of_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            base[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(base))
    texts += ["", None, " ", texts[0], texts[0].upper()]
    df = h.docs(spark, [(1000 - i, t) for i, t in enumerate(texts)])
    got = {r.id: (r.fingerprint, r.component_id) for r in op.near_duplicate_classes(df).collect()}
    prints = [print_of(t) for t in texts][::-1]  # in the order of ids
    ids = sorted(got)
    want = components(prints)
    assert got == {ids[i]: (signed(prints[i]), ids[want[i]]) for i in range(len(ids))}
    kept = op.one_of_each_component(h.with_clashing_columns(df))
    assert {r.doc_id for r in kept.collect()} == {ids[i] for i in range(len(ids)) if want[i] == i}


def test_odd_rows_and_empty_table(spark):
    df = h.odd(spark)
    got = h.rows(op.near_duplicate_classes(h.with_clashing_columns(df)))
    assert len(got) == df.count()
    assert {(i, c) for i, f, c in got if f == 0} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert {c for i, f, c in got if i in (4, 5)} == {4}
    assert op.one_of_each_component(df).where("doc_id is null").count() == 2
    assert op.near_duplicate_classes(h.docs(spark, [])).count() == 0
    assert op.one_of_each_component(h.docs(spark, [])).count() == 0


def test_columns_named_like_the_added_one(spark):
    df = h.docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "other words here now")])
    got = op.one_of_each_component(df.selectExpr("*", "7 as Kept_ID", "8 as kept_id_", "9 as __kept_id"))
    assert sorted((r.doc_id, r["Kept_ID"], r["kept_id_"], r["__kept_id"]) for r in got.collect()) == [(1, 7, 8, 9), (3, 7, 8, 9)]
