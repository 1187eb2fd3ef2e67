"""Quality rules: a threshold table compiled into one projection, without user functions.

Every rule is a row (name, measure, least, most, from how many words on). ``measures`` turns a text
into counts, ``verdicts`` compiles the table into one boolean expression over them; both are built-in
columns, so a scan, a projection and nothing else runs, and no row leaves its task.

Stop words are English, German, French and Spanish, so 'few stop words' judges only texts whose ``lang`` is one of these
(also as en-GB), is null or empty, or is not a column.

Nulls: a null text has no words. Empty texts, empty tables and repeated rows need no special case;
further columns are carried along by ``judge`` unless they bear the name of a measure, which replaces
them. Very long texts are measured whole; time grows as n log n with the words of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hazelake.llm.common import SPACE_CHARACTERS, let, words_of, whole_text

# --- fixed values ----------------------------------------------------------------------------
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the and of to in is that was for with on as at by from this be are it or "
    "der die das und ist nicht mit von zu den ein eine einen auf für "
    "le la les de des et en un une du que qui dans pour par sur avec "
    "el los las y que se por con para no al lo una su"
).split()
STOP_LANGUAGES = ("en", "de", "fr", "es")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0
    languages: tuple[str, ...] = ()


BASE = (
    Rule("too short", "n_words", least=10),
    Rule("repeats itself", "repeat_percent", most=20),
)
TABLE = (
    Rule("odd word length", "mean_word_chars", least=1.5, most=25),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("few stop words", "stop_ratio", least=0.01, from_words=100, languages=STOP_LANGUAGES),
    Rule("repeated lines", "dup_line_ratio", most=0.5),
)


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more; ``windows`` has a hash per window start.

    Hashes are sorted with their places; a place counts if a neighbour has the same hash, and the
    union of the windows that start there is summed up over the gaps between places.
    """

    def places(z):
        same = lambda a, b: a["h"].eqNullSafe(b["h"])
        marked = F.transform(
            F.sequence(F.lit(0), F.size(z) - 1),
            lambda j: F.when(
                same(F.get(z, j), F.get(z, j - 1)) | same(F.get(z, j), F.get(z, j + 1)), F.get(z, j)["i"]
            ),
        )
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(ordered, places),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def measures(df: DataFrame, column: str = "text") -> DataFrame:
    """The frame with the counts of each text and the ratios that rules compare."""
    text = whole_text(column)
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARACTERS, "")) > 0)

    def hashes(w):
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)

    df = df.withColumn("_words", words_of(text))
    df = df.withColumns({
        "_windows": F.when(F.size("_words") >= WINDOW, let(F.col("_words"), hashes)),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE_CHARACTERS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))),
        "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
    })
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    per_word = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    df = df.withColumns({
        "n_dup_lines": (F.col("_lines.all") - F.col("_lines.distinct")).cast("long"),
        "n_repeat_words": F.when(repeats, repeated_words(F.col("_windows"))).otherwise(0).cast("long"),
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbols_per_word": F.col("n_symbols") / per_word,
        "stop_ratio": F.col("_stops") / per_word,
    })
    return df.withColumns({
        "repeat_percent": F.lit(100.0) * F.col("n_repeat_words") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_lines.all"), F.lit(1)),
    }).drop("_words", "_windows", "_lines", "_stops")


def language(df: DataFrame) -> Column:
    """The language of each row in lower case without its region, null if it is not known."""
    if not any(c.lower() == "lang" for c in df.columns):
        return F.lit(None).cast("string")
    code = F.regexp_extract(F.lower(F.trim(F.col("lang").cast("string"))), "^[^-_]*", 0)
    return F.when(code != "", code)


def fails(rule: Rule, lang: Column) -> Column:
    value, tests = F.col(rule.measure), F.lit(False)
    if rule.least is not None:
        tests = tests | (value < rule.least)
    if rule.most is not None:
        tests = tests | (value > rule.most)
    if rule.languages:
        tests = tests & F.coalesce(lang.isin(*rule.languages), F.lit(True))
    return tests & (F.col("n_words") >= rule.from_words)


def any_of(rules, lang: Column) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | fails(rule, lang)
    return out


def judge(df: DataFrame, table=TABLE, base=BASE, column: str = "text") -> DataFrame:
    """The frame with its measures, ``base_failed``, ``kept`` and the names of the rules broken."""
    lang = language(df)
    broken = F.filter(
        F.array(*[F.when(fails(r, lang), F.lit(r.name)) for r in (*base, *table)]), lambda x: x.isNotNull()
    )
    return measures(df, column).withColumns({
        "base_failed": any_of(base, lang),
        "kept": ~any_of((*base, *table), lang),
        "broken_rules": F.concat_ws(", ", broken),
    })


def keep(df: DataFrame, table=TABLE, base=BASE, column: str = "text") -> DataFrame:
    """The rows that no rule rejects, columns as they came."""
    judged = judge(df.select(F.struct("*").alias("_row"), whole_text(column).alias("_text"), language(df).alias("lang")), table, base, "_text")
    return judged.where("kept").select("_row.*")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def sql(table=TABLE) -> str:
    """The same in DuckDB, for the columns of the query."""
    def condition(r):
        parts = [f"{r.measure} < {r.least!r}"] * (r.least is not None) + [f"{r.measure} > {r.most!r}"] * (r.most is not None)
        known = ", ".join(f"'{c}'" for c in r.languages)
        asked = f" AND (code IS NULL OR code IN ({known}))" if known else ""
        return f"(({' OR '.join(parts)}) AND n_words >= {r.from_words}{asked})"

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
  nullif(regexp_extract(lower(trim(CAST(lang AS VARCHAR))), '^[^-_]*', 0), '') AS code FROM documents),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
marked AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) AS x WHERE n > 1),
repeated AS (SELECT rid, count(*) AS n FROM (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM marked) AS y) AS z GROUP BY rid),
m AS (SELECT d.doc_id, d.code, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
  CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops
  FROM d JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
r AS (SELECT *, word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS mean_word_chars,
  n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) AS symbols_per_word,
  stops / CAST(greatest(n_words, 1) AS DOUBLE) AS stop_ratio,
  n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) AS dup_line_ratio,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(condition(r) for r in table)}) AS kept FROM r"""
