"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query. Postings (trigram, document) are
intersected as the query says, and only the documents left are verified with the expression itself.
Rules without a mandatory trigram scan every text. Postings are built for trigrams that some query
asks for; no other posting list could be read.

A posting names a document by a hash of its id and text. Documents with the same hash share candidate
rules, which can only add verifications, never lose a match. Nulls: a null text is empty, a null id is a
value like any other. Empty and very long texts are scanned whole; repeated rows are all returned; an
empty table gives no rows; further columns, whatever their names, stay out of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hazelake.llm import spans
from hazelake.llm.common import whole_text
from hazelake.llm.trigrams import clauses_of, trigrams


@dataclass(frozen=True)
class Rule:
    """``pattern`` without capturing groups; ``value`` (its last part) must have ``least`` characters."""

    kind: str
    pattern: str
    value: str | None = None
    least: int = 0


# --- fixed values: patterns -------------------------------------------------------------------
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         r"""^[^:=]*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"^(.*)$", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^/\x20\x09-\x0D:@]+:[^/\x20\x09-\x0D:@]+@"),
)
#: a run of hex digits is tried from its first digit only; long enough runs are then whole matches
AHEAD = {"hex": r"(?s:.*?[^0-9a-f])??"}


def queries(rules) -> list[tuple[str, int, int, str, int]]:
    """(kind, clause, alternative, trigram, trigrams of the alternative)."""
    return [
        (rule.kind, c, a, gram, len(grams))
        for rule in rules
        for c, clause in enumerate(clauses_of(rule.pattern))
        for a, grams in enumerate(map(trigrams, clause))
        for gram in grams
    ]


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key), each once, of a frame of (key, text)."""
    vocabulary = F.array(*[F.lit(g) for g in grams])
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(vocabulary, lambda g: F.contains(t, g)))[0]
    return texts.select(F.explode(held).alias("gram"), "key").distinct()


def candidates(texts: DataFrame, rules) -> DataFrame:
    """(key, kinds): the rules whose trigram query a document satisfies."""
    terms = queries(rules)
    wanted = texts.sparkSession.createDataFrame(terms, "kind string, clause int, alternative int, gram string, need int")
    hits = postings(texts, sorted({t[3] for t in terms})).join(F.broadcast(wanted), "gram")  # as many rows as the rules have trigrams
    clauses = wanted.groupBy("kind").agg(F.countDistinct("clause").alias("clauses"))
    held = (
        hits.groupBy("key", "kind", "clause", "alternative").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        .where("n = need")
        .groupBy("key", "kind").agg(F.countDistinct("clause").alias("held"))
    )
    full = held.join(F.broadcast(clauses), "kind").where("held = clauses")
    return full.groupBy("key").agg(F.collect_set("kind").alias("kinds"))  # no more than there are rules


def verified(text: Column, rule: Rule, when: Column) -> Column:
    found = spans.matches(text, rule.pattern, AHEAD.get(rule.kind, "(?s:.*?)"), when)
    if rule.value is None:
        return found
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.value, 1)) >= rule.least)


def scan(docs: DataFrame, column: str = "text", base=BASE, added=ADDED) -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans`` (arrays of order, kind, start, end)."""
    rules = (*base, *added)
    texts = docs.select("doc_id", whole_text(column).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    indexed = [r for r in rules if clauses_of(r.pattern)]
    named = {r.kind for r in indexed}
    joined = texts.join(candidates(texts.select("key", "text"), indexed), "key", "left")
    text = F.col("text")
    # texts without a run of the length asked for are told apart by one plain search
    scans = {"hex": text.rlike("[0-9a-f]{24}")}
    found = {
        r.kind: verified(text, r, F.array_contains("kinds", r.kind) if r.kind in named else scans.get(r.kind, F.lit(True)))
        for r in rules
    }
    out = joined.select("doc_id", *[c.alias(f"_{k}") for k, c in found.items()])
    return out.select(
        "doc_id",
        spans.by_kind({r.kind: F.col(f"_{r.kind}") for r in base}).alias("base"),
        spans.by_kind({r.kind: F.col(f"_{r.kind}") for r in rules}).alias("spans"),
    )


def _sql_spans(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    keep = "true"
    if rule.value:
        keep = f"length(regexp_extract(m[i], '{rule.value.replace(chr(39), chr(39) * 2)}', 1)) >= {rule.least}"
    at = f"regexp_extract_all(t, '((?s:.*?))({pattern})', %d)"
    return (
        f"SELECT rid, '{rule.kind}' AS kind, CAST(list_sum(list_transform(w[1:i], lambda x: length(x))) AS BIGINT) AS e, length(m[i]) AS n, {keep} AS good"
        f" FROM (SELECT rid, w, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, {at % 0} AS w, {at % 2} AS m FROM d) AS x) AS y"
    )


def sql(base=BASE, added=ADDED) -> str:
    every = "\nUNION ALL ".join(_sql_spans(r) for r in (*base, *added))
    order = " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate((*base, *added)))
    counted = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in base)
    is_base = "kind IN ({})".format(", ".join(f"'{r.kind}'" for r in base))
    joined = "coalesce(string_agg({0}, ',' ORDER BY s, o){1}, '')"
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, kind, e - n AS s, e, CASE kind {order} END AS o FROM (
{every}) AS z WHERE good),
g AS (SELECT rid, {counted}, {joined.format(one, f' FILTER ({is_base})')} AS base, {joined.format(one, '')} AS spans FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
