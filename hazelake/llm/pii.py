"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap. Boosted trees score each by its format and by
the words in front of it; a threshold per generator, calibrated on documents that were not trained on,
selects spans to redact besides those of the exact rules (e-mail, IPv4, card, phone), which all stay.

Only positives are known: a candidate that overlaps a span of an exact rule. All others are unlabelled, real data that
the rules miss among them. So each positive is shown a second time with the detail that gave it away hidden: '@' and
dots spelled out, '+' dropped (the checksum is no feature at all). Trees learn hidden and plain positives against the
unlabelled, and a generator's threshold is the score that ``RECALL`` of its hidden positives in held-out documents reach,
however many unlabelled ones reach it too. What the rules miss by such a detail scores like a hidden positive and is
added, be it rare or frequent. A generator whose hidden positives do not stand out, that is, reach the threshold less than
``LIFT`` times as often as the unlabelled do, adds nothing. Training takes at most ``TRAIN_ROWS`` candidates,
those with the smallest hash; calibration and scoring take all. With fewer than two classes nothing is added.

Nulls: a null text is empty, a null id a value like any other. Long texts are read whole, repeated rows
are all returned, an empty table gives no rows, further columns stay out of the way.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from hazelake.llm import spans
from hazelake.llm.common import whole_text, written
from hazelake.session import shared_folder

TRAIN_ROWS = 20_000
RECALL = 0.9
LIFT = 3.0
TREES = {"maxIter": 8, "maxDepth": 4, "seed": 42}
ADDED = "likely"

# --- fixed values: patterns; runs are tried from their first character and never given back ----
LOCAL, DIGITS = r"[A-Za-z0-9._%+-]", r"[0-9]"
BASE = {
    "email": (LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?s:.*?[^A-Za-z0-9._%+-])??"),
    "ip": (r"[0-9]++(?:\.[0-9]++){3}", r"(?s:.*?[^0-9])??"),
    "card": (r"[0-9](?:[\x20-]?+[0-9]){12,}+", r"(?s:.*?)"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"(?s:.*?)"),
}
GENERATORS = {
    "mail": (LOCAL + r"++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)*+", r"(?s:.*?[^A-Za-z0-9._%+-])??"),
    "dotted": (r"[0-9]++(?:\.[0-9]++){2,}+", r"(?s:.*?[^0-9])??"),
    "number": (r"[+(]?+[0-9](?:[\x20().-]{0,3}+[0-9]){6,}+", r"(?s:.*?)"),
}
#: a text without a match of these has no match of the pattern
TESTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "mail": r"@|\(at\)|\[at\]", "dotted": r"[0-9]\.[0-9]", "number": r"[0-9](?:[\x20().-]{0,3}[0-9]){6}",
}
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
CONTEXT_WORDS = {
    "near_phone": "tel|phone|call|mobile|fax|whatsapp",
    "near_card": "card|visa|credit|debit|iban",
    "near_host": "ip|host|addr|server|from",
    "near_mail": "mail|contact|write|reach",
}


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def term(d, i):
        doubled = d.cast("int") * (F.lit(1) + i % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    terms = F.transform(F.reverse(F.array_remove(F.split(digits, ""), "")), term)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": F.length(digits).between(13, 19) & luhn(digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    pattern, ahead = BASE[kind]
    found = spans.matches(text, pattern, ahead, text.rlike(TESTS[kind]))
    return F.filter(found, lambda s: holds(kind, s["value"]))


def proposals(text: Column) -> Column:
    """Spans of all generators; those of different generators may overlap."""

    def of(name):
        pattern, ahead = GENERATORS[name]
        found = spans.matches(text, pattern, ahead, text.rlike(TESTS[name]))
        return F.transform(found, lambda s: s.withField("generator", F.lit(name)))

    return F.concat(*map(of, GENERATORS))


def features(value: Column, before: Column) -> dict[str, Column]:
    count = lambda of: F.regexp_count(value, F.lit(of)).cast("double")
    before = F.lower(before)
    groups = F.split(F.regexp_replace(value, "[^0-9]+", " "), " ")
    return {
        "length": F.length(value).cast("double"),
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "groups": count("[0-9]+"),
        "longest_group": F.array_max(F.transform(groups, lambda g: F.length(g))).cast("double"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "blanks": count(r"\x20"),
        "brackets": count(r"[()\[\]]"),
        "at": count("@"),
        "plus": value.startswith("+").cast("double"),
        "glued": before.rlike("[A-Za-z0-9.]$").cast("double"),
        **{name: before.rlike(rf"\b(?:{words})\b").cast("double") for name, words in CONTEXT_WORDS.items()},
    }


def hidden(value: Column, draw: Column) -> Column:
    """A value as it might be written to evade the exact rules: one of several ways, by ``draw``."""
    at = F.element_at(F.array(*map(F.lit, (" (at) ", "(at)", " [at] ", "[at]"))), F.pmod(draw, F.lit(4)).cast("int") + 1)
    dot = F.element_at(F.array(*map(F.lit, ("(dot)", ".", "[dot]"))), F.pmod(F.shiftright(draw, 8), F.lit(3)).cast("int") + 1)
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.concat(name, at, F.replace(host, F.lit("."), dot))
    return F.when(F.contains(value, F.lit("@")), mail).otherwise(F.regexp_replace(value, r"^\+", ""))


def prepared(docs: DataFrame, column: str = "text") -> DataFrame:
    """One written row per document: exact spans and proposals, with a row number to join on and a hash of the text."""
    text = F.col("_text")
    rows = docs.select("doc_id", whole_text(column).alias("_text"))
    found = rows.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), *[base_spans(text, k).alias(f"_{k}") for k in BASE], proposals(text).alias("proposals")
    )
    base = spans.by_kind({k: F.col(f"_{k}") for k in BASE})
    return written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", base.alias("base"), "proposals"), "pii")


def labelled(rows: DataFrame, shown=None) -> DataFrame:
    """Proposals with features, and a label: 1 if an exact span overlaps. ``shown`` changes the values that are looked at."""
    each = rows.select("row", "doc_id", "base", F.explode("proposals").alias("p"))
    overlap = F.exists("base", lambda s: (s["start"] < F.col("p.end")) & (s["end"] > F.col("p.start")))
    draw = F.xxhash64("doc_id", "p")
    value = shown(F.col("p.value"), draw) if shown else F.col("p.value")
    kinds = [(F.col("p.generator") == g).cast("double").alias(f"is_{g}") for g in GENERATORS]
    named = [c.alias(n) for n, c in features(value, F.col("p.before")).items()]
    return each.select(
        "row", F.col("p.generator").alias("generator"), F.col("p.start").alias("start"), F.col("p.end").alias("end"),
        overlap.cast("double").alias("label"), draw.alias("draw"),
        (F.pmod(F.xxhash64("row", F.lit("held out")), F.lit(4)) == 0).alias("held_out"), *kinds, *named,
    )


def thresholds(scored: DataFrame) -> DataFrame:
    """Per generator the score (in hundredths) that ``RECALL`` of the held-out hidden positives reach, if they stand out."""
    held = scored.where("held_out").groupBy("generator", F.floor(F.col("score") * 100).alias("step")).agg(
        F.sum("label").alias("known"), F.sum(1 - F.col("label")).alias("other")
    )
    every = Window.partitionBy("generator")  # at most 101 steps
    above = every.orderBy(F.desc("step"))
    share = lambda c: F.try_divide(F.sum(c).over(above), F.sum(c).over(every))
    reached = held.select("generator", "step", share("known").alias("known"), F.coalesce(share("other"), F.lit(0.0)).alias("other"))
    best = reached.where(F.col("known") >= RECALL).groupBy("generator").agg(F.max_by(F.struct("step", "known", "other"), "step").alias("b"))
    return best.where(F.col("b.known") >= LIFT * F.col("b.other")).select("generator", (F.col("b.step") / 100).alias("least"))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans`` (arrays of order, kind, start, end), ``text_hash``."""
    shared_folder(docs.sparkSession)
    rows = prepared(docs, column)
    plain, disguised = labelled(rows), labelled(rows, hidden).where("label = 1")
    names = [c for c in plain.columns if c not in ("row", "generator", "start", "end", "label", "draw", "held_out")]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    shown = plain.unionByName(disguised).where("NOT held_out")
    # as many known as unlabelled ones, so that the trees look at both
    drawn = [shown.where(F.col("label") == k).orderBy("draw", "start", "length", "brackets").limit(TRAIN_ROWS // 2) for k in (0, 1)]
    train = written(assembler.transform(drawn[0].unionByName(drawn[1])).select("features", "label"), "pii-train")
    if train.select("label").distinct().count() < 2:
        return rows.select("doc_id", "base", F.col("base").alias("spans"), "text_hash")
    model = GBTClassifier(featuresCol="features", labelCol="label", **TREES).fit(train)

    def scores(given):
        out = model.transform(assembler.transform(given)).withColumn("score", vector_to_array("probability")[1])
        return out.select("row", "generator", "start", "end", "label", "held_out", "score")

    scored = scores(plain)
    least = thresholds(scores(disguised).unionByName(scored.where("label = 0")))
    chosen = scored.join(F.broadcast(least), "generator").where("label = 0 AND score >= least")  # a row per generator
    span = F.struct(F.lit(len(BASE)).alias("order"), F.lit(ADDED).alias("kind"), F.col("start"), F.col("end"))
    more = chosen.groupBy("row").agg(F.collect_set(span).alias("more"))  # spans of one document
    joined = rows.join(more, "row", "left")
    added = F.sort_array(F.coalesce("more", F.array().cast("array<struct<order:int,kind:string,start:int,end:int>>")))
    return joined.select("doc_id", "base", F.concat("base", added).alias("spans"), "text_hash")


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[redacted]", column: str = "text") -> DataFrame:
    """Texts with every span replaced; ``found`` comes from ``scan`` over these documents.

    Rows meet their spans by id and hash of the text, null ids included, so repeated ids and repeated rows are redacted like
    any other, once each. A row that was not scanned raises instead of passing as it is.
    """
    ordered = F.sort_array(F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    whole = whole_text(f"_row.`{column}`")

    def step(a, s):
        gap = F.substring(whole, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        inside = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(inside, a["text"]).otherwise(F.concat(a["text"], gap, F.lit(mark))).alias("text"),
        )

    rest = lambda a: F.concat(a["text"], F.substring(whole, a["at"] + 1, F.length(whole)))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_h", F.xxhash64(whole))
    known = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"), F.col("spans").alias("_s")).dropDuplicates(["_id", "_t"])
    joined = rows.join(known, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")
    text = F.when(F.col("_s").isNull(), F.raise_error(F.lit("a row that was not scanned")).cast("string")).when(
        F.size("_s") > 0, F.aggregate(ordered, empty, step, rest)
    ).otherwise(F.col(f"_row.`{column}`"))
    return joined.select(*[text.alias(c) if c == column else F.col(f"_row.`{c}`") for c in docs.columns])
