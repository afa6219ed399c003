"""The whole pipeline against a brute-force version of it on a small table."""

import corpus_pipeline
import helpers as h
import test_decontaminate
import test_simhash
from vecreduce.llm import language_id, mixing

SF = "/root/testdata/sf0.001"


def cut(text, items, window=10):
    """The text without its hit words and what stands between them; None if most words are hit."""
    places = [m.span() for m in test_decontaminate.WORD.finditer(h.ascii_lower(text))]
    found = test_decontaminate.words(text)
    hit = set()
    for item in items:
        w = test_decontaminate.words(item)
        k = min(window, len(w))
        runs = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(found) - k + 1):
            if tuple(found[i:i + k]) in runs:
                hit |= set(range(i, i + k))
    if 2 * len(hit) > len(found):
        return None
    for i in sorted(hit, reverse=True):  # a hit word goes, and the gap to the next one if that is hit too
        text = text[:places[i][0]] + text[places[i + 1][0] if i + 1 in hit else places[i][1]:]
    return text


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rows = docs.collect()
    found = language_id.Scorer(model)([r.text for r in rows])
    rows = [r for r, (lang, score) in zip(rows, found) if lang != "und" and score >= 0.5]
    newest = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        newest[h.ascii_lower(r.text)] = r
    rows = sorted(newest.values(), key=lambda r: r.doc_id)
    tops = test_simhash.components([test_simhash.print_of(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if tops[i] == i]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: (t, r.lang, r.source, len(t)) for r in rows if (t := cut(r.text, items)) is not None}

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "copy"]
    copies = {}
    for r in got.collect():
        assert (r.text, r.lang, r.source, r.n_chars) == kept[r.doc_id]
        copies.setdefault(r.doc_id, []).append(r.copy)
    left = spark.createDataFrame([(i, *row) for i, row in kept.items()], docs.schema)
    wanted = {r.id: r.copies for r in mixing.mixed(left).collect()}
    assert {i: sorted(c) for i, c in copies.items()} == {i: list(range(1, n + 1)) for i, n in wanted.items() if n}
    assert any(len(kept[i][0]) != len(r.text) for r in rows for i in [r.doc_id] if i in kept)
