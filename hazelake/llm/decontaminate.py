"""Benchmark decontamination by template windows.

Texts are brought to a template: numbers, names (capitalised words) and units behind numbers become typed
placeholders, other words lose case and punctuation. Windows of ``WINDOW`` template words, at least ``LITERALS``
of them literal, are hashed and joined to those of the benchmark. A document and an item that share enough windows
(``COVERED`` of the item's, or a run of ``RUN`` words) are aligned, and what fills the item's slots is compared
with what fills the document's: on one alignment each value of the item must stand for one value of the document.
So a question with other numbers or names is caught, and a text that only has the same shape is not. Where a value
stands for several, the windows that cover a slot which it changed do not count; all others do, verbatim ones above
all, and are tested for enough again. A pair that needs such an alignment is never ``exact``.

The benchmark's windows go to all executors only while they are fewer than ``MOST_BROADCAST``; beyond that they
are shuffled. Documents travel only as (key, place) of shared windows; the words of a document are taken apart
again only for those that pass the first test.

Nulls: a null text is empty and never contaminated; a null item_id is an item like any other, a null doc_id a
document. Items with fewer than five words or without a window of enough literal words match nothing. Repeated
rows are judged alike. Empty tables give no rows; columns of other names are carried along by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazelake.llm.common import SPACES, free_name, let, whole_text, written

WINDOW = 5
LITERALS = 3
COVERED = 0.8
RUN = 13
MOST_BROADCAST = 200_000

# --- fixed values: templates ------------------------------------------------------------------
S = r"\x20\x09-\x0D"
NUMBER, NAME, UNIT = "⟨n⟩", "⟨x⟩", "⟨u⟩"
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|feet|foot|ft|inch|inches|l|ml|litres?|liters?|hours?|hrs?|h|minutes?|min|"
    "seconds?|sec|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph"
)
STEPS = (
    (rf"(^|[{S}])[^\p{{L}}\p{{N}}{S}]*\p{{Nd}}[^{S}]*", NUMBER),
    (rf"(^|[{S}])[^\p{{L}}\p{{N}}{S}]*\p{{Lu}}[^{S}]*", NAME),
    (rf"({NUMBER}[{S}]+)(?:{UNITS})[^\p{{L}}\p{{N}}{S}]*", UNIT),
)
PUNCTUATION = rf"[^\p{{L}}\p{{N}}\p{{M}}{S}⟨⟩]+"


def template(text: Column) -> Column:
    """The template of a text, its white space untouched."""
    number, name, unit = STEPS
    out = F.regexp_replace(text, number[0], f"$1{number[1]}")
    out = F.regexp_replace(out, name[0], f"$1{name[1]}")
    out = F.when(F.contains(out, F.lit(NUMBER)), F.regexp_replace(out, unit[0] + rf"(?=[{S}]|$)", f"$1{unit[1]}")).otherwise(out)
    return F.regexp_replace(F.lower(out), PUNCTUATION, "")


def words(column: Column) -> Column:
    return F.array_remove(F.split(column, SPACES), "")


def window_hashes(column: Column) -> Column:
    """Hash of the window at each word, null where it has too few literal words."""

    def at(w, i):
        own = [F.get(w, i + k) for k in range(WINDOW)]
        literal = sum((F.when(F.startswith(x, F.lit("⟨")), 0).otherwise(1) for x in own), F.lit(0))
        return F.when(literal >= LITERALS, F.xxhash64(*own))

    def hashes(w):
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: at(w, i))
        return F.when(F.size(w) >= WINDOW, each)

    return let(words(column), hashes)


def windows(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(hash, key, place) of a frame of (key, text)."""
    spread = rows.select(F.col(key), F.posexplode(window_hashes(template(F.col("text")))).alias(place, "hash"))
    return spread.where("hash IS NOT NULL")


def tokens(rows: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(key, place, value, slot): the words of the texts as they stand, numbered like template words."""
    single = f"[{S}]"
    both = F.arrays_zip(F.split("text", single).alias("word"), F.split(template(F.col("text")), single).alias("shape"))
    kept = F.filter(both, lambda t: t["shape"] != "")
    spread = rows.select(F.col(key), F.posexplode(kept).alias(place, "t"))
    bare = F.regexp_replace(F.lower("t.word"), PUNCTUATION, "")
    return spread.select(key, place, bare.alias(value), F.startswith("t.shape", F.lit("⟨")).alias("slot"))


def _enough(matches: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Pairs of key and item that share enough windows, with their alignments."""
    aligned = matches.withColumn("shift", F.col("place") - F.col("item_place"))
    streak = Window.partitionBy(key, "item", "shift").orderBy("place")  # one document, one item
    runs = aligned.withColumn("streak", F.col("place") - F.row_number().over(streak)).groupBy(key, "item", "shift", "streak").agg(F.count("*").alias("run"))
    longest = runs.groupBy(key, "item").agg((F.max("run") + WINDOW - 1).alias("run"))
    covered = matches.groupBy(key, "item").agg(F.countDistinct("item_place").alias("n"))
    both = covered.join(longest, [key, "item"]).join(items, "item")
    return both.where((F.col("n") >= F.lit(COVERED) * F.col("item_windows")) | (F.col("run") >= RUN))


def contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """(key, doc_id, item_id, exact) per document and item; key is a hash of id and text."""
    text = whole_text(column)
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    items = benchmark.select("item_id", whole_text("text").alias("text")).withColumn("item", F.xxhash64("item_id", "text")).distinct()
    of_items = written(windows(items, "item", "item_place"), "benchmark-windows")
    sizes = of_items.groupBy("item").agg(F.count("*").alias("item_windows"))
    few = of_items.count() <= MOST_BROADCAST
    matches = windows(rows.select("key", "text"), "key", "place").join(F.broadcast(of_items) if few else of_items, "hash")
    matches = written(matches.select("key", "item", "place", "item_place").distinct(), "matches")
    likely = _enough(matches, sizes, "key").select("key", "item")
    near = matches.join(likely, ["key", "item"], "left_semi")
    texts = rows.join(likely.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    k = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1)))
    cells = near.withColumn("k", k).select("key", "item", (F.col("place") - F.col("item_place")).alias("shift"),
                                           (F.col("place") + F.col("k")).alias("place"), (F.col("item_place") + F.col("k")).alias("item_place")).distinct()
    slots = tokens(items, "item", "item_place", "asked").where("slot").drop("slot")
    filled = cells.join(slots, ["item", "item_place"]).join(tokens(texts, "key", "place", "given").drop("slot"), ["key", "place"])
    filled = written(filled.select("key", "item", "shift", "place", "asked", "given"), "slots")
    values = filled.groupBy("key", "item", "shift").agg(
        F.countDistinct("asked").alias("asked"), F.countDistinct("asked", "given").alias("pairs"),
        F.min((F.col("asked") == F.col("given")).cast("int")).alias("same"),
    )
    several = filled.groupBy("key", "item", "shift", "asked").agg(F.min("given").alias("low"), F.max("given").alias("high")).where("low <> high")
    changed = filled.where("asked <> given").join(several, ["key", "item", "shift", "asked"], "left_semi")
    over = changed.withColumn("k", k).select("key", "item", "shift", (F.col("place") - F.col("k")).alias("place")).distinct()
    judged = near.withColumn("shift", F.col("place") - F.col("item_place")).join(values, ["key", "item", "shift"], "left")
    firm = judged.where(F.coalesce(F.col("asked") == F.col("pairs"), F.lit(True)))
    sound = judged.join(over, ["key", "item", "shift", "place"], "left_anti")
    final = _enough(sound.select("key", "item", "place", "item_place"), sizes, "key").select("key", "item")
    certain = _enough(firm.select("key", "item", "place", "item_place"), sizes, "key").select("key", "item")
    alike = firm.groupBy("key", "item").agg((F.min(F.coalesce("same", F.lit(1))) == 1).alias("exact"))
    exact = certain.join(alike, ["key", "item"])
    out = final.join(exact, ["key", "item"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    out = out.join(items.select("item", "item_id"), "item")
    return out.join(texts.select("key", "doc_id"), "key").select("key", "doc_id", "item_id", "exact")


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """One row per contaminated document: doc_id, how many items, whether one is exact, the items."""
    found = contaminated(docs, benchmark, column)
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("exact").alias("exact"),
        F.array_join(F.sort_array(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"),  # of one document
    )


def clean(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark item, columns as they came."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", whole_text(column)))
    bad = contaminated(docs, benchmark, column).select(F.col("key").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_template(x: str) -> str:
    number, name, unit = STEPS
    out = f"regexp_replace({x}, '{number[0]}', '\\1{number[1]}', 'g')"
    out = f"regexp_replace({out}, '{name[0]}', '\\1{name[1]}', 'g')"
    out = rf"regexp_replace({out}, '{unit[0]}([{S}]|$)', '\1{unit[1]}\2', 'g')"
    return f"regexp_replace(lower({out}), '{PUNCTUATION}', '', 'g')"


def sql() -> str:
    enough = lambda m: f"""SELECT key, item FROM (SELECT key, item, count(DISTINCT item_place) AS n FROM {m} GROUP BY ALL) AS a
 JOIN (SELECT key, item, max(n) + {WINDOW - 1} AS run FROM (SELECT key, item, shift, streak, count(*) AS n FROM
   (SELECT *, place - row_number() OVER (PARTITION BY key, item, shift ORDER BY place) AS streak FROM {m}) AS b GROUP BY ALL) AS c GROUP BY ALL) AS d USING (key, item)
 JOIN sizes USING (item) WHERE n >= {COVERED}e0 * item_windows OR run >= {RUN}"""  # noqa: E731
    single = rf"[{S}]"

    def parts(name, key, source):
        return rf"""{name}_w AS (SELECT {key}, list_filter(string_split_regex(tmpl, '{single}'), lambda x: x <> '') AS w FROM {source}),
{name} AS (SELECT {key}, i AS place, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS g FROM (SELECT {key}, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM {name}_w) AS x
  WHERE len(list_filter(w[i + 1:i + {WINDOW}], lambda x: x[1] <> '⟨')) >= {LITERALS}),
{name}_t AS (SELECT {key}, unnest(range(0, len(z))) AS place, unnest(list_transform(z, lambda t: regexp_replace(lower(t.a), '{PUNCTUATION}', '', 'g'))) AS value,
  unnest(list_transform(z, lambda t: t.b[1] = '⟨')) AS slot FROM (SELECT {key}, list_filter(list_transform(range(1, len(o) + 1), lambda i: {{'a': o[i], 'b': p[i]}}), lambda t: t.b <> '') AS z
   FROM (SELECT {key}, string_split_regex(text, '{single}') AS o, string_split_regex(tmpl, '{single}') AS p FROM {source}) AS y) AS v)"""

    return f"""
WITH d AS (SELECT *, {_sql_template('text')} AS tmpl FROM (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents) AS x),
b AS (SELECT *, {_sql_template('text')} AS tmpl FROM (SELECT row_number() OVER () AS item, item_id, coalesce(text, '') AS text FROM (SELECT DISTINCT item_id, text FROM benchmark) AS y) AS x),
{parts('dw', 'key', 'd')},
{parts('bw', 'item', 'b')},
sizes AS (SELECT item, count(*) AS item_windows FROM bw GROUP BY item),
m AS (SELECT DISTINCT key, item, dw.place, bw.place AS item_place, dw.place - bw.place AS shift FROM dw JOIN bw USING (g)),
likely AS ({enough('m')}),
near AS (SELECT m.* FROM m JOIN likely USING (key, item)),
cells AS (SELECT DISTINCT key, item, shift, place + k AS place, item_place + k AS item_place FROM near, range(0, {WINDOW}) AS r(k)),
filled AS (SELECT c.key, c.item, c.shift, c.place, s.value AS asked, t.value AS given FROM cells c JOIN bw_t s ON s.item = c.item AND s.place = c.item_place AND s.slot
  JOIN dw_t t ON t.key = c.key AND t.place = c.place),
vals AS (SELECT key, item, shift, count(DISTINCT asked) = count(DISTINCT (asked, given)) AS firm, bool_and(asked = given) AS same FROM filled GROUP BY ALL),
several AS (SELECT key, item, shift, asked FROM filled GROUP BY ALL HAVING min(given) <> max(given)),
gone AS (SELECT DISTINCT key, item, shift, place - k AS place FROM (SELECT filled.* FROM filled SEMI JOIN several USING (key, item, shift, asked) WHERE asked <> given) AS x, range(0, {WINDOW}) AS r(k)),
sound AS (SELECT near.* FROM near ANTI JOIN gone USING (key, item, shift, place)),
firm AS (SELECT near.*, coalesce(same, true) AS same FROM near LEFT JOIN vals USING (key, item, shift) WHERE coalesce(vals.firm, true)),
final AS ({enough('sound')}),
certain AS ({enough('firm')}),
exact AS (SELECT key, item, bool_and(same) AS same FROM firm JOIN certain USING (key, item) GROUP BY ALL),
hits AS (SELECT d.doc_id, b.item_id, coalesce(exact.same, false) AS same FROM final LEFT JOIN exact USING (key, item) JOIN d USING (key) JOIN b USING (item))
SELECT doc_id, count(DISTINCT item_id) AS n_items, bool_or(same) AS exact, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id"""
