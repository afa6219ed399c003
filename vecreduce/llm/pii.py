"""Personal data spans from DataFrame functions only: patterns, checksums, context words.

A kind's pattern proposes leftmost non-overlapping matches.  A validator confirms them:
Luhn for card numbers, mod 97 for account numbers, ranges and digit counts for the rest.
Words near a match raise its score.  Spans of the base kinds (email, ip, card, phone) are
reported once validated; spans of the added kinds (iban, ssn, key, secret) need a score of
``threshold`` too.  A ``key`` has a published credential format or is a private-key block; a
``secret`` is any mixed run of 20 to 200 letters, digits and underscores that stands near a
word for a credential.

The base patterns are possessive and start only where a run of their characters starts, so
no text makes them backtrack; they match what the plain patterns below match, less
proposals that fail validation anyway.  The added patterns are of bounded length.

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)          parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                          13 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                     9 to 15 digits

Positions are code points, end exclusive.  They come from the lengths of matches and of
the pieces between them, summed in blocks, so a text with very many matches takes little
more than linear time.  No row meets another: there is no shuffle.

Defined cases: null and empty texts have no spans.  Spans of different kinds may overlap.
Repeated rows give repeated results.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import col

THRESHOLD = 0.5
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``needs``: a cheap pattern without which a text has no match; ``check``: SQL over ``m``, the match.

    ``prior`` is the score of a proposal that ``check`` confirms, ``boost`` what a context word adds.
    """

    name: str
    needs: str
    pattern: str
    check: str
    context: str
    prior: float
    boost: float
    base: bool = True


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_MOD97 = ("aggregate(transform(sequence(1, length(a)), i -> ascii(substr(a, i, 1))), 0, (r, c) -> "
          "if(c < 58, (r * 10 + c - 48) % 97, (r * 100 + c - 55) % 97)) = 1")
_IBAN = "concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4))"

_CREDENTIAL = "token|secret|passw|credential|bearer|authori|[ _-]key|key ?[:=]"

KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "true", "mail|contact|write to", 0.8, 0.2),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
         "host|server|address|login", 0.6, 0.3),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"(?<![0-9][\x20-]?)[0-9](?:[\x20-]?+[0-9]){12,}+",
         f"length({_DIGITS}) <= 19 and luhn_check({_DIGITS})", "card|visa|credit|payment", 0.7, 0.3),
    Kind("phone", r"\+[0-9]", r"\+[0-9](?:[\x20().-]*+[0-9])++",
         f"length({_DIGITS}) between 9 and 15", "phone|tel|call|mobile|fax", 0.6, 0.3),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]",
         r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
         f"exists(array({_IBAN}), a -> {_MOD97})", "iban|account|bank", 0.8, 0.2, base=False),
    Kind("ssn", "[0-9]-[0-9]", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
         "substr(m, 1, 3) not in ('000', '666') and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'",
         "ssn|social security", 0.3, 0.4, base=False),
    Kind("key", "PRIVATE KEY-----|A[KS]IA[A-Z0-9]|gh[pousr]_|xox[abprs]-|AIza|sk-[A-Za-z0-9]",
         r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9_])|gh[pousr]_[A-Za-z0-9]{36,200}+"
         r"|xox[abprs]-[A-Za-z0-9-]{10,200}+|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,200}+)"
         r"|-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----[^-]*+(?:-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----)?",
         "m rlike '[0-9]|PRIVATE KEY'", _CREDENTIAL, 0.8, 0.2, base=False),
    Kind("secret", "[A-Za-z0-9_]{20}", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,200}+(?![A-Za-z0-9_])",
         "m rlike '[0-9]' and m rlike '[A-Za-z]' and size(array_distinct(regexp_extract_all(m, '.', 0))) >= 8",
         _CREDENTIAL, 0.3, 0.4, base=False),
)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _add_spans(df: DataFrame, kind: Kind, threshold: float) -> DataFrame:
    """``df`` with an array column of the kind's spans: kind, start, end, score."""
    none = "cast(array() as array<string>)"
    pattern = _literal(kind.pattern)
    df = df.withColumn("found", F.expr(
        f"if(text rlike {_literal(kind.needs)}, regexp_extract_all(text, {pattern}, 0), {none})"))
    df = df.withColumn("pieces", F.expr(f"if(size(found) > 0, split(text, {pattern}, -1), {none})"))
    # steps[k]: from the start of match k - 1 (or of the text) to the start of match k
    df = df.withColumn("steps", F.expr(
        "transform(found, (m, k) -> length(pieces[k]) + if(k > 0, length(found[k - 1]), 0))"))
    df = df.withColumn("sums", F.expr(
        f"transform(sequence(0, size(steps) div {BLOCK}), b -> "
        f"aggregate(slice(steps, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))"))
    df = df.withColumn("before", F.expr(
        "transform(sums, (x, b) -> aggregate(slice(sums, 1, b), 0L, (s, x) -> s + x))"))
    start = (f"before[k div {BLOCK}] + aggregate(slice(steps, (k div {BLOCK}) * {BLOCK} + 1, k % {BLOCK} + 1), "
             "0L, (s, x) -> s + x)")
    # the text before and after match k, over neighbouring matches too; each has at least one character
    left = (f"aggregate(sequence(greatest(k - {CONTEXT_BEFORE}, 0), k), '', (s, i) -> right(concat(s, "
            f"if(i > 0, right(found[greatest(i - 1, 0)], {CONTEXT_BEFORE}), ''), "
            f"right(pieces[i], {CONTEXT_BEFORE})), {CONTEXT_BEFORE}))")
    right = (f"aggregate(sequence(k + 1, least(k + {CONTEXT_AFTER}, size(found))), '', (s, i) -> left(concat(s, "
             f"left(pieces[i], {CONTEXT_AFTER}), left(coalesce(get(found, i), ''), {CONTEXT_AFTER})), {CONTEXT_AFTER}))")
    near = f"concat({left}, ' ', {right})"
    df = df.withColumn(kind.name, F.expr(
        f"filter(transform(found, (m, k) -> if({kind.check}, named_struct("
        f"'kind', '{kind.name}', 'start', {start}, 'end', {start} + length(m), 'score', "
        f"round({kind.prior}d + if(lower({near}) rlike {_literal(kind.context)}, {kind.boost}d, 0d), 2)), null)), "
        f"s -> s is not null and ({str(kind.base).lower()} or s.score >= {threshold}))"))
    return df.drop("found", "pieces", "steps", "sums", "before")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS,
          threshold: float = THRESHOLD) -> DataFrame:
    """``id`` and one array of spans (kind, start, end, score) for each kind, in text order."""
    found = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    for kind in kinds:
        found = _add_spans(found, kind, threshold)
    return found.drop("text")


def listed(*arrays: Column) -> Column:
    """``kind:start:end`` of all spans of the arrays, comma-joined."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
