import hashlib

import helpers as h
import pytest
from vecreduce.llm import exact_dedup as op


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(h.ascii_lower(t), []).append(i)
    out = []
    for i, t in pairs:
        ids = groups[h.ascii_lower(t)]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(h.ascii_lower(t).encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("digest", [op._digest, lambda text: 7])
def test_classes_equal_brute_force_even_if_all_digests_collide(spark, digest):
    pairs = [(i, f"Text {i % 7}".upper() if i % 3 else f"text {i % 7}") for i in range(200)]
    pairs += [(200 + i, "É" if i % 2 else "é") for i in range(10)]
    got = h.rows(op.duplicate_classes(h.docs(spark, pairs).repartition(5), digest=digest))
    assert sorted(got) == sorted(brute(pairs))


def test_odd_rows(spark):
    df = h.odd(spark)
    pairs = [(r.doc_id, r.text) for r in df.collect()]
    got = h.rows(op.duplicate_classes(h.with_clashing_columns(df)))
    assert sorted(got, key=key) == sorted(brute(pairs), key=key)


def test_survivors_are_one_row_of_each_text_with_its_own_columns(spark):
    df = h.with_clashing_columns(h.odd(spark))
    got = op.surviving_rows(df)
    assert got.schema == df.schema
    kept = got.select("doc_id", "text", "kept").collect()
    assert sorted((r.doc_id, r.kept) for r in kept) == [(i, "kept") for i in (2, 3, 5, 7, 8)]
    assert {h.ascii_lower(r.text) for r in kept} == {h.ascii_lower(r.text) for r in df.collect()}


def test_empty_table(spark):
    assert op.duplicate_classes(h.docs(spark, [])).count() == 0
    assert op.surviving_rows(h.docs(spark, [])).count() == 0
