import random
import re

import helpers as h
import pytest
from vecreduce.llm import decontaminate as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(h.ascii_lower(text))


def brute(text, items, window=10):
    found, hit, ids = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        k = min(window, len(w))
        if k:
            runs = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
            for i in range(len(found) - k + 1):
                if tuple(found[i:i + k]) in runs:
                    hit |= set(range(i, i + k))
                    ids |= set() if item is None else {str(item)}
    return len(found), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    few = [f"w{i}" for i in range(4)]
    many = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    items += [(100 + i, " ".join(rng.choice(many) for _ in range(30))) for i in range(15)]
    items += [(200, "x y"), (201, "x y z x y"), (202, None), (203, "..."), (None, "only by null id here"), (200, "p q")]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            own = [rng.choice(few if rng.random() < .6 else many) for _ in range(rng.randint(1, 30))]
            parts.append(rng.choice([" ", ", ", "\n"]).join(own))
            if rng.random() < .5:
                w = (rng.choice(items)[1] or "").split()
                a = rng.randrange(len(w) + 1)
                parts.append(" - ".join(w[a:a + rng.randint(5, 30)]).upper())
        texts.append(". ".join(parts))
    return items, texts + ["x y", "x y z x y z", "only BY null id here!", "", None, "été x, y"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_equal_brute_force(spark, case, block_bytes):
    items, texts = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = h.docs(spark, list(enumerate(texts))).repartition(3)
    got = {r.id: (r.n_words, r.n_hit, r["items"])
           for r in op.matched(df, bench, block_bytes=block_bytes).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}


def test_spans_are_cut_and_covered_documents_go(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "No benchmark here: alpha beta gamma delta, and éven some Unicode."
    df = h.docs(spark, [(1, clean), (2, f"Before it é, {item.upper()}! {clean}"), (3, f"{item} end"), (4, None), (5, "")])
    got = {r.doc_id: (r.text, r.n_chars) for r in op.remove_spans(df, bench, length_col="n_chars").collect()}
    cut = f"Before it é, ! {clean}"
    assert got == {1: (clean, len(clean)), 2: (cut, len(cut)), 4: (None, None), 5: ("", 0)}
    assert op.matched(h.docs(spark, [(2, cut)]), bench).first().n_hit == 0


def test_odd_rows_and_empty_tables(spark):
    df = h.with_clashing_columns(h.odd(spark))
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.matched(df, none).where("n_hit > 0").count() == 0
    kept = op.remove_spans(df, none)
    assert kept.schema == df.schema and kept.count() == df.count()
    bench = spark.createDataFrame([("a,b", "lorem ipsum dolor"), (None, None)], "item_id string, text string")
    found = {r.id: r for r in op.matched(df, bench).collect()}
    assert found[4].n_hit == 3 * 20_000 and found[4]["items"] == ["a,b"] and found[5].n_hit == found[4].n_hit
    assert op.matched(h.docs(spark, []), bench).count() == 0


def test_one_repeated_word_takes_time_in_proportion():
    import time
    start = time.perf_counter()
    many = [b"same"] * 200_000
    automaton = op.SuffixAutomaton([("1", many), ("2", [b"same"] * 3), ("3", [b"same", b"other"])])
    spans, items = automaton.matches(many)
    assert spans == [(0, 200_000)] and items == {"1", "2"} and time.perf_counter() - start < 20


def test_short_items_inside_longer_runs():
    items = [("a", [b"x"]), ("b", [b"y", b"x"]), ("c", [b"z", b"y", b"x", b"w"]), ("d", [b"x", b"w"] * 6)]
    automaton = op.SuffixAutomaton(items)
    for words, spans, found in [([b"x"], [(0, 1)], {"a"}), ([b"q", b"y", b"x"], [(1, 3)], {"a", "b"}),
                                ([b"y", b"y"], [], set()), ([b"z", b"y", b"x", b"w"], [(0, 4)], {"a", "b", "c"})]:
        assert automaton.matches(words) == (spans, found)


def test_blocks_save_hits_only_and_cut_alike(spark, case, monkeypatch):
    items, texts = case
    long = " ".join(f"u{i % 97}x{i % 89}" for i in range(3_000))
    bench = spark.createDataFrame(items + [(300, long)], "item_id long, text string")
    inside = " ".join(long.split()[700:760])
    rows = list(enumerate(texts)) + [(1000 + i, f"before {inside} after") for i in range(50)] + [
        (None, f"{long} and a clean end"), (2000, long)]
    df = h.with_clashing_columns(h.docs(spark, rows)).repartition(4)
    saved, tables = op.saved, []

    def kept(table, name):
        tables.append((name, saved(table, name)))
        return tables[-1][1]

    monkeypatch.setattr(op, "saved", kept)
    one = op.remove_spans(df, bench, length_col="n_chars").collect()
    assert not tables
    several = op.remove_spans(df, bench, length_col="n_chars", block_bytes=2_000).collect()
    assert sorted(map(str, several)) == sorted(map(str, one))
    hits = [t for name, t in tables if name == "decontaminate-hits"]
    assert len(hits) > 5 and all(t.columns == ["digest", "spans", "items"] for t in hits)
    assert all(t.count() == t.select("digest").distinct().count() <= len(set(texts)) + 3 for t in hits)
    parts = [t for name, t in tables if name == "decontaminate-items"][0]
    assert parts.where("item = '300'").count() > 50
    assert op.matched(df, bench, block_bytes=2_000).where("id = 2000").first()["items"] == ["300"]


def test_a_column_of_dots_and_spaces_holds_the_text(spark):
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(40)], "item_id long, text string")
    df = h.docs(spark, [(1, "x a7 b7 c7 y"), (2, "a1 b2 c3")]).withColumnRenamed("text", "my.text here")
    for block_bytes in (1 << 20, 100):
        found = {r.id: (r.n_hit, r["items"]) for r in op.matched(df, bench, text_col="my.text here",
                                                                  block_bytes=block_bytes).collect()}
        assert found == {1: (3, ["7"]), 2: (0, [])}
