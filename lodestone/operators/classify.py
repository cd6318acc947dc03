"""Rule-based classification: topics, intents, notice kinds, and labels from outside."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalise


@dataclass(frozen=True)
class Rule:
    """A class with the phrases that name it, and the markers that confirm it in a title or a body."""

    key: str
    keywords: tuple[str, ...]
    title_markers: tuple[str, ...] = ()
    action_markers: tuple[str, ...] = ()
    evidence_markers: tuple[str, ...] = ()
    questions: tuple[str, ...] = ()
    exclusion_markers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]
    default: str
    recency: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    aliases: tuple[tuple[str, ...], ...] = field(default=())
    kinds: tuple[Rule, ...] = ()
    default_kind: str | None = None
    intents: dict[str, tuple[Rule, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys = [r.key for r in self.rules]
        if not keys or len(set(keys)) != len(keys) or not all(k.strip() for k in keys):
            raise ValueError("rules need distinct keys")
        if self.default not in keys:
            raise ValueError("the default is no rule's key")
        if self.kinds and self.default_kind not in {k.key for k in self.kinds}:
            raise ValueError("the default kind is no kind's key")
        if set(self.intents) - set(keys):
            raise ValueError("intents of an unknown topic")
        for values in (*(v for r in self.rules for v in (r.keywords, r.title_markers, r.action_markers, r.evidence_markers)), self.recency, self.generic, *self.aliases):
            if not all(v.strip() for v in values) or len(set(values)) != len(values):
                raise ValueError("phrases must be distinct and not blank")
        if any(len(group) < 2 for group in self.aliases):
            raise ValueError("an alias group needs two phrases")


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """A catalog from a JSON file with `default_topic_key`, `topics` with their `intents`, `retrieval_policy` and
    `notice_kinds`."""
    raw = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).take(1)))
    pick = lambda t, k: tuple(str(x).strip() for x in t.get(k) or ())
    rules = tuple(Rule(t["key"], pick(t, "keywords"), pick(t, "title_markers"), pick(t, "body_action_markers"), pick(t, "evidence_markers"), pick(t, "suggested_questions")) for t in raw["topics"])
    policy = raw.get("retrieval_policy") or {}
    kinds = tuple(Rule(k["key"], pick(k, "keywords")) for k in raw.get("notice_kinds") or ())
    intents = {t["key"]: tuple(Rule(i["key"], pick(i, "keywords"), evidence_markers=pick(i, "evidence_markers"), exclusion_markers=pick(i, "exclusion_markers")) for i in t["intents"]) for t in raw["topics"] if t.get("intents")}
    return Catalog(rules, raw["default_topic_key"], pick(policy, "recency_terms"), pick(policy, "generic_terms"), tuple(tuple(g) for g in policy.get("alias_groups") or ()), kinds, raw.get("default_notice_kind_key"), intents)


def _fold(phrase: str) -> str:
    return " ".join(phrase.casefold().split())


def longest_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Key of the rule with the longest phrase in the text (case and white space folded); of equals the first rule.

    The phrases become one CASE from longest to shortest, evaluated with the scan: no join, no shuffle.
    """
    phrases = sorted(((-len(_fold(k)), n, _fold(k), r.key) for n, r in enumerate(rules) for k in r.keywords if _fold(k)))

    def first(folded: Column) -> Column:
        out = F
        for _, _, phrase, key in phrases:
            out = out.when(F.contains(folded, F.lit(phrase)), key)
        return out.otherwise(F.lit(None))

    # The text is folded once for all phrases: an array of one element binds it.
    return F.transform(F.array(normalise(text)), first)[0] if phrases else F.lit(None).cast("string")


def topic(text: Column, catalog: Catalog, override: Column | None = None) -> Column:
    """The topic's key: a known override, else the longest match, else the default."""
    found = F.coalesce(longest_match(text, catalog.rules), F.lit(catalog.default))
    return found if override is None else F.when(override.isin(*[r.key for r in catalog.rules]), override).otherwise(found)


def topic_title_first(title: Column, body: Column, catalog: Catalog) -> Column:
    """Title phrases, then title markers, then a body sentence with a phrase and an action marker, then the default."""
    marked = tuple(Rule(r.key, r.title_markers) for r in catalog.rules)
    lines = sentences(body)
    found = [longest_match(title, catalog.rules), longest_match(title, marked)]
    for r in catalog.rules:
        if r.keywords and r.action_markers:
            found.append(F.when(F.exists(F.transform(lines, normalise), _both(r)), r.key))
    return F.coalesce(*found, F.lit(catalog.default))


def _both(rule: Rule):
    """Whether a sentence has one of the rule's phrases and one of its action markers."""

    def test(sentence: Column) -> Column:
        has = lambda values: F.exists(F.array(*[F.lit(_fold(v)) for v in values]), lambda v: F.contains(sentence, v))
        return has(rule.keywords) & has(rule.action_markers)

    return test


def sentences(text: Column) -> Column:
    """Lines, and their sentences."""
    return F.split(text, r"(?<=[.!?])\s+|\n+")


def notice_kind(title: Column, body: Column, kinds: tuple[Rule, ...], default: str) -> Column:
    """The kind that the title names, else the one that the first sentence of the body to name one names, else the
    default. A phrase counts within one sentence only."""
    named = F.filter(F.transform(sentences(body), lambda s: longest_match(s, kinds)), lambda k: k.isNotNull())
    return F.coalesce(longest_match(title, kinds), F.try_element_at(named, F.lit(1)), F.lit(default))


def compatible_kind(asked: Column, kind: Column, bound: tuple[str, ...]) -> Column:
    """Whether a notice of this kind may answer: questions of a `bound` kind take their own kind only, others any."""
    return F.coalesce(~asked.isin(*bound) | (asked == kind), F.lit(True))


def intent(title: Column, body: Column, topic_key: Column, catalog: Catalog, override: Column | None = None) -> Column:
    """The intent's key within a topic: a known override, else the longest phrase in the title, else in the body, else
    the topic's first intent; null where the topic has none."""
    out = F
    for key, rules in catalog.intents.items():
        if rules:
            found = F.coalesce(longest_match(title, rules), longest_match(body, rules), F.lit(rules[0].key))
            out = out.when(topic_key == key, found if override is None else F.when(override.isin(*[r.key for r in rules]), override).otherwise(found))
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None))


def ranked(texts: DataFrame, rules: tuple[Rule, ...], limit: int = 3) -> DataFrame:
    """(id, key, hits, place): up to `limit` rules of each text by number of phrases found; of equals the first rule."""
    folded = normalise(F.col("text"))
    scored = [F.struct(F.lit(n).alias("n"), F.lit(r.key).alias("key"), sum((F.contains(F.col("_folded"), F.lit(_fold(k))).cast("int") for k in r.keywords), F.lit(0)).alias("hits")) for n, r in enumerate(rules)]
    rows = texts.select("id", folded.alias("_folded")).select("id", F.explode(F.array(*scored)).alias("r")).select("id", "r.*").where("hits > 0")
    by = Window.partitionBy("id").orderBy(F.desc("hits"), "n")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("id", "key", "hits", "place")


def allowed_label(label: Column, allowed: dict[str, str]) -> Column:
    """The key of a label from outside; an unknown label is an error."""
    out = F.when(label.isNull(), F.lit(None).cast("string"))
    for name, key in allowed.items():
        out = out.when(label == name, key)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string"))


def confirmed(key: Column, options: Column) -> Column:
    """The confirmed intent if it is one of the options; null asks again."""
    return F.when(F.array_contains(options, key), key)


def suggested(key: Column, catalog: Catalog, most: int = 3) -> Column:
    """Up to `most` questions of a topic in declared order, filled up from the default topic's."""
    by_key = {r.key: r.questions for r in catalog.rules}
    texts = lambda own: F.array(*[F.lit(q) for q in list(dict.fromkeys((*own, *by_key[catalog.default])))[:most]]).cast("array<string>")
    out = F
    for k, questions in by_key.items():
        out = out.when(key == k, texts(questions))
    return out.otherwise(texts(()))
