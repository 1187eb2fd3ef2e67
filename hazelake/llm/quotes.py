"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes, one level for each. Neighbouring lines of a level form a passage. Lines and
passages are normalised (letters and digits, lower case) and joined by hash to what messages say themselves. A quote
is of the first message of its own conversation that said so before it, or else of the first message of all that did. A
message replies to what most of its quoted words are from, at the lowest level that is linked. Conversations that quote
one another are one thread. In a thread a reply stands with the message at the root of its chain of replies, by depth;
the rest keep their order. Messages come out as ``role: text`` without quotes and without the lines that announce them.

For each normalised passage one original is kept per conversation and one over all, before any join: a common line
costs as many rows as it is quoted, never that times as it is said. Chains are followed in rounds that double their
reach.

Nulls: a null text is empty; messages with a null conversation or turn quote but are not quoted, and are threads of their
own (null). A null role is empty text. Repeated rows are all returned; a reply names a message by conversation and turn. Passages
of fewer than ``LEAST_WORDS`` words link nothing. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazelake.llm.common import whole_text, written
from hazelake.llm.graph import components

LEAST_WORDS = 3
# --- fixed values: marks of quotes --------------------------------------------------------------
MARKS = r"^(?:\x20{0,3}>)+\x20?"
ANNOUNCED = r"(?i)^(?:on .* wrote|.* schrieb|.* a écrit|.* escribió)\x20?:$"


def parsed(messages: DataFrame, column: str = "text") -> DataFrame:
    """(row, conv, turn, place, level, line, body) for every line."""
    lines = messages.select("row", "conv", "turn", F.posexplode(F.split(whole_text(column), "\n")).alias("place", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    bare = F.regexp_replace("line", MARKS, "")
    return lines.select(
        "row", "conv", "turn", "place", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), bare.alias("line"),
        F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " ")).alias("body"),
    )


def units(lines: DataFrame) -> DataFrame:
    """Distinct normalised lines and passages: (row, conv, turn, level, body, words)."""
    streak = F.col("place") - F.row_number().over(Window.partitionBy("row", "level").orderBy("place"))  # one message
    runs = lines.withColumn("run", streak).groupBy("row", "conv", "turn", "level", "run")
    passages = runs.agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("all")).where(F.size("all") > 1)
    whole = F.array_join(F.filter(F.col("all.body"), lambda b: b != ""), " ")
    each = lines.select("row", "conv", "turn", "level", "body").union(passages.select("row", "conv", "turn", "level", whole))
    counted = each.withColumn("words", F.size(F.split("body", " ")))
    return counted.where(F.col("words") >= LEAST_WORDS).distinct()


def linked(parts: DataFrame) -> DataFrame:
    """(row, conv, turn, to_conv, to_turn, n_linked): what each message with a linked quote replies to."""
    said = parts.where("level = 0 AND conv IS NOT NULL AND turn IS NOT NULL").withColumn("hash", F.xxhash64("body"))
    here = said.groupBy(F.col("conv").alias("here"), F.col("hash").alias("said")).agg(F.min("turn").alias("first"))
    anywhere = said.groupBy(F.col("hash").alias("said")).agg(F.min(F.struct("conv", "turn")).alias("first_of_all"))
    quoted = parts.where("level > 0").withColumn("hash", F.xxhash64("body"))
    near = quoted.join(here, (F.col("conv") == F.col("here")) & (F.col("hash") == F.col("said")) & (F.col("first") < F.col("turn")), "left").drop("said")
    far = near.join(anywhere, F.col("hash") == F.col("said"), "left")
    own = F.col("here").isNotNull()
    earlier = (F.col("first_of_all.conv") < F.col("conv")) | F.col("conv").isNull() | F.col("turn").isNull()
    target = F.when(own, F.struct(F.col("conv"), F.col("first").alias("turn"))).when(earlier, F.col("first_of_all"))
    votes = far.withColumn("to", target).where("to IS NOT NULL").groupBy("row", "conv", "turn", "level", "to").agg(
        F.sum("words").alias("words"), F.count("*").alias("n")
    )
    best = F.struct("level", -F.col("words"), F.when(F.col("to.conv") == F.col("conv"), 0).otherwise(1), "to")
    return votes.groupBy("row", "conv", "turn").agg(F.min_by("to", best).alias("to"), F.sum("n").alias("n_linked")).select(
        "row", "conv", "turn", F.col("to.conv").alias("to_conv"), F.col("to.turn").alias("to_turn"), "n_linked"
    )


def chains(links: DataFrame) -> DataFrame:
    """(conv, turn, root_conv, root_turn, depth) of messages that reply; every round doubles the reach."""
    one = links.where("conv IS NOT NULL AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.min(F.struct("to_conv", "to_turn")).alias("to"))
    now = written(one.select("conv", "turn", F.col("to.to_conv").alias("root_conv"), F.col("to.to_turn").alias("root_turn"), F.lit(1).alias("depth")), "chains")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root_conv").alias("rc"), F.col("root_turn").alias("rt"), F.col("depth").alias("d"))
        joined = now.join(up, (F.col("root_conv") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
        after = written(joined.select(
            "conv", "turn", F.coalesce("rc", "root_conv").alias("root_conv"), F.coalesce("rt", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved"),
        ), "chains")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def conversations(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages in reply order, a row each, without quotes."""
    numbered = written(messages.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        "role", F.col(column).alias("text"),
    ), "messages")
    quoting = numbered.where(F.contains("text", F.lit(">")) & F.col("text").rlike(r"(?m)" + MARKS))
    # originals are wanted only where something is quoted
    lines = parsed(numbered)
    parts = units(lines.join(quoting.select("row"), "row", "left_semi").where("level > 0")).unionByName(
        units(lines.where("level = 0"))
    )
    links = written(linked(parts), "links")
    across = links.where("conv <> to_conv").select(F.col("conv").alias("a"), F.col("to_conv").alias("b"))
    threads = components(across)
    roots = chains(links)
    text = whole_text()
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(MARKS) & ~x.rlike(ANNOUNCED))
    body = F.when(F.contains(text, F.lit(">")) & text.rlike(r"(?m)" + MARKS), F.trim(F.array_join(kept, "\n"))).otherwise(text)
    quotes = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(MARKS)))
    out = (
        numbered.join(links.select("row", "to_conv", "to_turn", "n_linked"), "row", "left")
        .join(threads, F.col("conv") == F.col("node"), "left")
        .join(roots.withColumnsRenamed({"conv": "_c", "turn": "_t"}), (F.col("conv") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    )
    return out.select(
        F.coalesce("root", "conv").alias("thread_id"), F.coalesce("root_conv", "conv").alias("branch_conv"), F.coalesce("root_turn", "turn").alias("branch_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("conv").alias("conv_id"), "turn",
        F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"), quotes.cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.concat(F.coalesce("role", F.lit("")), F.lit(": "), body).alias("message"),
    ).orderBy("thread_id", "branch_conv", "branch_turn", "depth", "conv_id", "turn")
