"""Checks of answers and error messages before they are shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip

#: Response types, and titles of an answer's sections.
TYPES = ("clarification", "answer", "no_answer")
SECTIONS = ("확인한 최신 공지", "핵심 내용", "원문 확인")
#: What an error message must not show.
UNSAFE = {
    "line_break": r"[\r\n]",
    "markup": r"(?i)</?[a-z][^>]*>|<!doctype\s+html",
    "trace": r"(?i)\b(?:traceback|stack\s+trace)\b",
    "setting": r"(?i)(?:API_KEY|PASSWORD|SECRET|TOKEN)\s*[:=]\s*\S+",
    "token": r"(?i)\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    "error_name": r"(?i)\b(?:Error|Exception|[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception))\s*:",
    "header": r"(?i)\b(?:authorization|cookie)\s*:",
    "bearer": r"(?i)\bbearer\s+\S+",
    "windows_path": r"(?i)(?:^|[^\w])[A-Za-z]:[\\/]",
    "posix_path": r"(?:^|[^\w])/(?:[^/]|$)",
}
#: An address, an endpoint that a message may name, a particle after it, and a sign that ends it.
URL = r"(?i)https?://[^\s<>\"']+"
ENDPOINT = r"(?i)/api/(?:health|live)"
PARTICLE = r"^(?:에서|으로|정도|를|을|은|는|이|가|에|로|와|과|의|도|만)"
PUNCTUATION = r"^[.,!;:。、，．！…]"


def _without_endpoints(x: Column) -> Column:
    """A text without the endpoints that it names as such: the mention, with or without a particle, ends the text, stands
    before white space, or before a sign that itself ends the text or stands before white space or a Korean word."""
    between = F.split(x, ENDPOINT)

    def back(part: Column, i: Column) -> Column:
        bare = F.regexp_replace(part, PARTICLE, "")
        behind = F.substring(bare, F.lit(2), F.length(bare))
        stops = lambda s: s.rlike(r"^\s") | ((s == "") & (i == F.size(between) - 1))
        named = stops(bare) | (bare.rlike(PUNCTUATION) & (stops(behind) | behind.rlike("^[가-힣]")))
        return F.when((i == 0) | named, part).otherwise(F.concat(F.lit("/api/live"), part))

    return F.array_join(F.transform(between, back), "")


def response_type(x: Column) -> Column:
    """The type, `answer` if none is given; null for an unknown one."""
    given = F.coalesce(x, F.lit("answer"))
    return F.when(given.isin(*TYPES), given)


def web_url(x: Column) -> Column:
    """Whether it is a web address without a user's name or password."""
    scheme, user, host = (F.try_parse_url(strip(x), F.lit(p)) for p in ("PROTOCOL", "USERINFO", "HOST"))
    return F.coalesce(F.lower(scheme).isin("http", "https") & user.isNull() & host.isNotNull(), F.lit(False))


def first_unsafe(x: Column) -> Column:
    """The first reason for which a message may not be shown; null if none of UNSAFE holds."""
    out = F
    for name, pattern in UNSAFE.items():
        seen = _without_endpoints(F.regexp_replace(x, URL, "")) if name == "posix_path" else x
        out = out.when(seen.rlike(pattern), name)
    return out


def safe_message(x: Column) -> Column:
    """One line of 1 to 500 characters, in Korean, that shows nothing internal; addresses in it are plain ones."""
    bare = strip(x)
    plain_urls = ~F.exists(F.regexp_extract_all(bare, F.lit(URL), F.lit(0)), lambda u: u.rlike("[?#]|://[^/]*@"))
    return F.coalesce(F.length(bare).between(1, 500) & first_unsafe(bare).isNull() & plain_urls & bare.rlike("[가-힣]"), F.lit(False))


def error_text(body: Column, content_type: Column, fallback: str) -> Column:
    """A safe message from a JSON body's `detail` or from a plain body, else the fallback."""
    detail = F.get_json_object(F.when(F.try_parse_json(body).isNotNull(), body), "$.detail")
    said = F.coalesce(detail, F.when(F.contains(F.lower(content_type), F.lit("text/plain")), body))
    return F.when(safe_message(said), strip(said)).otherwise(F.lit(fallback))


def line_class(line: Column) -> Column:
    """How a line of an answer is shown."""
    bare = strip(line)
    return (
        F.when(bare == "", "spacer").when(bare.isin(*SECTIONS), "section").when(bare.rlike(r"^[0-9]+\.\s"), "notice")
        .when(bare.rlike(r"^(?:분류|게시일)\s*·"), "meta").when(bare.startswith("- "), "bullet").when(bare.rlike(r"^출처\s*·"), "citation").otherwise("line")
    )


def source_label(x: Column, known: str, first: str, other: str) -> Column:
    return F.when(x == known, first).otherwise(other)


def response_fault(kind: Column, answer: Column, grounded: Column, sources: Column, intent: Column, options: Column) -> Column:
    """The first rule that a response breaks; null if it keeps all.

    `sources` is an array of structs (title, url, source, published_at, score).
    """
    kind = response_type(kind)
    good = F.forall(sources, lambda s: (strip(s["title"]) != "") & web_url(s["url"]) & (strip(s["source"]) != "") & s["score"].isNotNull() & ~F.isnan(s["score"]) & (F.abs(s["score"]) != float("inf")) & (s["published_at"].isNull() | (strip(s["published_at"]) != "")))
    return (
        F.when(kind.isNull(), "type").when(F.coalesce(strip(answer) == "", F.lit(True)), "answer").when(~F.coalesce(good, F.lit(False)), "source")
        .when((kind == "clarification") & (F.coalesce(grounded, F.lit(True)) | (F.size(sources) > 0) | intent.isNull() | (F.size(options) == 0)), "clarification")
        .when((kind == "no_answer") & (F.coalesce(grounded, F.lit(False)) | (F.size(sources) > 0)), "no_answer")
    )
