import re

import helpers as h
from hypothesis import given, settings, strategies as st
from vecreduce.llm import pii as op
from pyspark.sql import functions as F

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items()
                    for m in re.finditer(p, text or "") if passes(k, m.group()))


def base(df):
    found = op.spans(df)
    return {r.id: r.s for r in found.select("id", op.listed(*[F.col(k) for k in PLAIN]).alias("s")).collect()}


def test_written_cases(spark):
    texts = [None, "", "write to é😀 a.b@c.de, or x@y", "a@b.c_d@e.f a@b.c.@x.y", "1.2.3.4.5.6.7.8 300.1.2.3 001.2.3.255",
             "4111 1111 1111 1111 and 4111-1111-1111-1112", "12 4111111111111111", "0000000000000", "+1 (017) 555-7713.",
             "+123 +1 2 +999999999999 (12", "+1+22222222 22", "9" * 50_000 + " " + "a" * 50_000, "a@" + "b." * 30_000 + "c",
             "x@y.z " * 700]
    df = h.docs(spark, list(enumerate(texts)))
    assert base(df) == {i: brute(t) for i, t in enumerate(texts)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="01259.@+- ()a_%é😀\n", max_size=60), min_size=40, max_size=60))
def test_random_texts_equal_the_plain_patterns(spark, texts):
    df = h.docs(spark, list(enumerate(texts)))
    assert base(df) == {i: brute(t) for i, t in enumerate(texts)}


def test_added_kinds_need_their_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "GB82WEST12345698765432",
             "my SSN is 123-45-6789", "part 123-45-6789 of", "ssn 000-45-6789"]
    got = {r.id: (r.iban, r.ssn) for r in op.spans(h.docs(spark, list(enumerate(texts)))).collect()}
    spans = {i: [(s.kind, s.start, s.end, s.score) for s in a + b] for i, (a, b) in got.items()}
    assert spans == {0: [("iban", 5, 32, 1.0)], 1: [], 2: [("iban", 0, 22, 0.8)], 3: [("ssn", 10, 21, 0.7)], 4: [], 5: []}


def test_context_raises_the_score(spark):
    got = op.spans(h.docs(spark, [(1, "call +1 (017) 555-7713"), (2, "was +1 (017) 555-7713")])).collect()
    assert {r.id: r.phone[0].score for r in got} == {1: 0.9, 2: 0.6}


def test_context_reaches_over_neighbouring_matches(spark):
    two, many = "123-45-6789, 234-56-7890", ", ".join(f"{n}-45-6789" for n in range(100, 160))
    texts = ["SSN: " + two, two + " SSN", "é😀 ssn " + many, many + " ssn", "x" * 40 + "SSN" + "x" * 36 + " 123-45-6789",
             "SSN" + "x" * 38 + " 123-45-6789", "123-45-6789 " + "x" * 16 + "ssn", "123-45-6789 " + "x" * 17 + "ssn",
             "call 1.2.3.4 +1 (017) 555-7713, +1 (017) 555-7714", two]
    got = op.spans(h.docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        text, want = texts[r.id], []
        for m in re.finditer(r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)", text):
            near = text[max(0, m.start() - 40):m.start()] + " " + text[m.end():m.end() + 20]
            if "ssn" in near.lower():
                want.append((m.start(), m.end(), 0.7))
        assert [(s.start, s.end, s.score) for s in r.ssn] == want
    sizes = {r.id: len(r.ssn) for r in got}
    assert sizes == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0}
    assert [p.score for r in got if r.id == 8 for p in r.phone] == [0.9, 0.9]


def test_odd_rows_and_empty_table(spark):
    df = h.odd(spark)
    assert op.spans(h.with_clashing_columns(df)).count() == df.count()
    assert op.spans(h.docs(spark, [])).count() == 0


def test_credentials(spark):
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    block = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow+/=\n-----END RSA PRIVATE KEY-----"
    aws, github = "AKIA" + "J4Q2" * 4, "ghp_" + "a1B2" * 9
    texts = [f'token = "{hexes}"', f"commit {hexes}", f"api key: {hexes}, {hexes}", f"é😀 {aws} and", f"x{aws}", f"{github}.",
             f"a {block} b", "-----BEGIN PRIVATE KEY-----", "password " + "a" * 30, "token " + "a1b2c3d4" * 26, "sk-" + "aB3_" * 9,
             "BEGIN PRIVATE KEY", "secret " + "x1" * 100_000]
    got = {r.id: [(s.kind, s.start, s.end, s.score) for s in r.key + r.secret]
           for r in op.spans(h.docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [("secret", 9, 49, 0.7)], 1: [], 2: [("secret", 9, 49, 0.7)],  # the second is out of its reach
                  
                   3: [("key", 3, 23, 0.8)], 4: [], 5: [("key", 0, 40, 0.8)], 6: [("key", 2, 2 + len(block), 0.8)],
                   7: [("key", 0, 27, 0.8)], 8: [], 9: [], 10: [("key", 0, 39, 0.8)], 11: [], 12: []}


def test_query_equals_its_sql_on_lists_and_credentials(spark, tmp_path):
    import duckdb
    from vecreduce.llm import queries
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [None, "", "SSN: 123-45-6789, 234-56-7890", "123-45-6789, 234-56-7890 ssn", f"token: {hexes} {hexes}", f"sum {hexes}",
             "é😀 AKIA" + "J4Q2" * 4 + " ghp_" + "a1B2" * 9, "x -----BEGIN EC PRIVATE KEY-----\nab\n-----END EC PRIVATE KEY----- y",
             "mail a@b.c and +1 (017) 555-7713 call, host 1.2.3.4; card 4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00"]
    df = h.docs(spark, list(enumerate(texts)))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op4_pii']})").fetchall()
    assert sorted(h.rows(got)) == sorted(want)
