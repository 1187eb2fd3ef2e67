"""Places of pattern matches in whole texts, with built-in functions only.

Spark extracts matches but not their places. Here a match is extracted together with the text since
the one before, so that running sums of lengths are places, in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
CONTEXT = 24


def matches(text: Column, pattern: str, ahead: str = "(?s:.*?)", when: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (start, end, value, a few characters before it).

    ``ahead`` matches what may stand between two matches. One that ends in front of a run, as in
    ``(?s:.*?[^0-9])??``, keeps a run of digits from being tried from each of its digits. ``pattern``
    must not have groups that capture. ``when`` is a cheap test without which there is no match.
    """
    anchored = rf"\G({ahead})({pattern})"
    whole, values = (F.regexp_extract_all(text, F.lit(anchored), F.lit(g)) for g in (0, 2))
    before = lambda w, v: F.right(F.left(w, F.length(w) - F.length(v)), F.lit(CONTEXT))
    steps = F.zip_with(
        whole, values, lambda w, v: F.struct(F.length(w).alias("n"), v.alias("value"), before(w, v).alias("before"))
    )
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(acc, x):
        end = acc["at"] + x["n"]
        span = F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.array_append(acc["found"], span).alias("found"))

    found = F.aggregate(steps, nothing, add, lambda acc: acc["found"])
    return found if when is None else F.when(when, found).otherwise(F.array().cast(SPAN))


def by_kind(found: dict[str, Column]) -> Column:
    """One array of (order, kind, start, end) over several kinds, kinds numbered as listed."""

    def tagged(i, kind, spans):
        return F.transform(
            spans, lambda s: F.struct(F.lit(i).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    return F.concat(*[tagged(i, kind, spans) for i, (kind, spans) in enumerate(found.items())])


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, first: str) -> Column:
    """``kind:start:end`` joined by commas; sorted by place (``first="start"``) or by kind (``"order"``)."""
    then = "order" if first == "start" else "start"
    keyed = F.transform(
        spans, lambda s: F.struct(s[first].alias("a"), s[then].alias("b"), s["end"].alias("c"), s["kind"].alias("kind"), s["start"].alias("start"))
    )
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["c"].cast("string"))
    return F.array_join(F.transform(F.sort_array(keyed), text), ",")
