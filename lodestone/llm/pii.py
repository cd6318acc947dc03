"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

DataFrame functions only. A kind's matches are found twice by the same pattern: regexp_extract_all gives the matches
and split gives the text between them, so that running lengths give each match's place, in code points and in bytes.
Every pattern starts only where no earlier start could reach the same match and never gives a character back, so that
long runs of one character cost linear time; running sums are taken in chunks, and texts are cut by bytes, so that many
spans in a long text do not cost their square either.

Kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits), and iban (ISO 7064 mod-97),
key (tokens that services issue, and password assignments) and ssn (nine digits as 3-2-4), which the method adds. A
span's score is its kind's, raised if one of the kind's context words is in the `NEAR` characters before it, back to the
match of its kind before. Spans count from a score of `LEAST`: those of kinds that nothing confirms (ssn) only by their
context, all others in any case.

Defined results: a null text counts as empty and has no spans; repeated rows and null ids are treated row by row; an
empty table gives no rows; columns other than `doc_id` and `text` are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import row_of

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "key", "ssn")
#: The length of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LC PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|password=[^\x20\x09-\x0D]++)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that every text with a match passes.
_NEEDS = {"email": "@", "phone": "+"}
#: Score of a span, the least that counts, and the words before it that raise the score.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "key": 0.8, "ssn": 0.4}
CONTEXT = {"email": "mail|e-mail|contact", "ip": "ip|address|host|server", "card": "card|visa|credit|payment", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "key": "key|secret|token|aws", "ssn": "ssn|social|security|taxpayer"}
RAISE, NEAR, LEAST = 0.1, 40, 0.5
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CHUNK = 256


def _let(name: str, value: str, then: str) -> str:
    """SQL of `then`, which uses `name` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def running(values: str, join: Callable[[str, str], str]) -> str:
    """SQL of what `join` makes of the values before each place (0 for the first), for arrays of any size.

    An array is built value by value in chunks only, so that the work grows with the size and not with its square.
    """
    scan = lambda x: f"aggregate({x}, named_struct('now', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)), (acc, v) -> named_struct('now', CAST({join('acc.now', 'v')} AS BIGINT), 'out', concat(acc.out, array(acc.now))))"
    chunks = f"transform(sequence(0, CAST(ceil(size(r_x) / {_CHUNK}) AS INT) - 1), r_k -> {scan(f'slice(r_x, r_k * {_CHUNK} + 1, {_CHUNK})')})"
    before = scan("transform(r_c, r_y -> r_y.now)") + ".out"
    whole = _let("r_c", chunks, f"flatten(zip_with(r_c, {before}, (r_d, r_w) -> transform(r_d.out, r_v -> {join('r_w', 'r_v')})))")
    return _let("r_x", values, f"CASE WHEN size(r_x) <= {_CHUNK} THEN {scan('r_x')}.out ELSE {whole} END")


def _luhn(digits: str) -> str:
    """SQL: whether up to 20 digits have a right Luhn check digit."""
    digit = "CAST(substr(CASE WHEN i % 2 = 0 THEN l_p ELSE translate(l_p, '0123456789', '0246813579') END, i, 1) AS INT)"
    return _let("l_p", f"lpad({digits}, 20, '0')", f"aggregate(sequence(1, 20), 0, (s, i) -> s + {digit}) % 10 = 0")


def _mod97(iban: str) -> str:
    """SQL: whether an IBAN (letters and digits, no spaces) leaves 1 modulo 97 with its first four characters last."""
    code = "CASE WHEN c RLIKE '[0-9]' THEN try_cast(c AS INT) ELSE ascii(c) - 55 END"
    return _let("i_t", f"concat(substr({iban}, 5), left({iban}, 4))", f"aggregate(split(i_t, '(?!^|$)'), 0, (r, c) -> (r * CASE WHEN c RLIKE '[0-9]' THEN 10 ELSE 100 END + {code}) % 97) = 1")


def _valid(kind: str, match: str) -> str:
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    if kind == "ip":
        return rf"{match} RLIKE r'^{_OCTET}(?:\.{_OCTET}){{3}}$'"
    if kind == "card":
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {_luhn(digits)} ELSE false END"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    return _mod97(f"replace({match}, ' ', '')") if kind == "iban" else "true"


_SPAN = "ARRAY<STRUCT<start: INT, rank: INT, kind: STRING, end: INT, score: DOUBLE, at: INT, bytes: INT>>"


def _spans(text: str, kind: str) -> str:
    """SQL of the confirmed spans of one kind, in order; `at` and `bytes` are the first byte and the number of bytes."""
    add = lambda a, b: f"{a} + {b}"
    sums = ", ".join(running(f"transform(p, y -> {size}(y.gap) + {size}(y.match))", add) for size in ("length", "octet_length"))
    pairs = "zip_with(slice(f.gaps, 1, size(f.matches)), f.matches, (g, m) -> named_struct('gap', g, 'match', m))"
    found = f"named_struct('matches', regexp_extract_all({text}, r'{PATTERNS[kind]}', 0), 'gaps', split({text}, r'{PATTERNS[kind]}', -1))"
    proposed = _let("f", found, _let("p", pairs, f"zip_with(p, zip_with({sums}, (n, o) -> named_struct('chars', n, 'octets', o)), (q, w) -> named_struct('gap', q.gap, 'match', q.match, 'chars', w.chars, 'octets', w.octets))"))
    start = "CAST(x.chars + length(x.gap) AS INT)"
    near = f"right(x.gap, {NEAR}) RLIKE r'(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])'"
    score = f"least(CAST({SCORES[kind]} AS DOUBLE) + CASE WHEN {near} THEN CAST({RAISE} AS DOUBLE) ELSE 0D END, 1D)"
    span = f"named_struct('start', {start}, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'end', {start} + length(x.match), 'score', {score}, 'at', CAST(x.octets + octet_length(x.gap) AS INT), 'bytes', octet_length(x.match))"
    out = f"CAST(transform(filter({proposed}, x -> {_valid(kind, 'x.match')}), x -> {span}) AS {_SPAN})"
    if SCORES[kind] < LEAST:
        out = f"filter({out}, x -> x.score >= {LEAST})"
    test = f"contains({text}, '{_NEEDS[kind]}')" if kind in _NEEDS else f"{text} RLIKE r'{PATTERNS[kind]}'"
    return f"CASE WHEN {test} THEN {out} ELSE CAST(array() AS {_SPAN}) END"


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """The rows of `docs` with all spans that count, by start and then kind; `text` must be a string."""
    each = ", ".join(_spans("coalesce(CAST(text AS STRING), '')", k) for k in KINDS)
    return docs.withColumn(name, F.expr(f"sort_array(concat({each}))"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: spans are (start, rank, kind, end, score, at, bytes), in code points, `end`
    exclusive, and in bytes."""
    return with_spans(docs.select(F.col("doc_id").cast("long"), "text"), "spans").select("doc_id", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base kinds' spans, and all spans and their scores as text."""
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda x: F.round(x["score"], 2).cast("string")), ",")
    return scanned.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, least_score: float = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, with every span of at least `least_score` replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the first one's kind; `n_chars`, where there, follows the text.
    """
    rows = with_spans(docs.select(row_of(docs).alias("row"), F.col("text").cast("string").alias("text")), "spans")
    rows = rows.select("row", "text", F.filter("spans", lambda x: x["score"] >= least_score).alias("spans"))
    cut = lambda begin, n: f"CAST(substr(raw, CAST({begin} AS INT) + 1, CAST({n} AS INT)) AS STRING)"
    reached = running("ends", lambda a, b: f"greatest({a}, {b})")
    kept = f"filter(zip_with(spans, {reached}, (x, w) -> named_struct('kind', x.kind, 'at', x.at, 'from', w)), s -> s.at >= s.from)"
    parts = f"transform({kept}, s -> concat({cut('s.from', 's.at - s.from')}, '[', upper(s.kind), ']'))"
    tail = cut("array_max(ends)", "octet_length(text) - array_max(ends)")
    clean = F.expr(_let("raw", "CAST(text AS BINARY)", _let("ends", "transform(spans, x -> x.at + x.bytes)", f"concat(array_join({parts}, ''), {tail})")))
    out = rows.select("row", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
