"""Personal data by patterns, and by bootstrapped context for what the patterns don't match.

Entities that the base patterns find are seeds. The words around them are lexical patterns; other
identifier-like tokens stand among such words too. Patterns and instances form a graph that is scored in turns:
a pattern is as good as the instances it holds, an instance as good as the patterns that hold it. Tokens that
good patterns vouch for become spans. Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.session import staged

# The kinds in the order of the contract.
KINDS = ["email", "ip", "card", "phone"]

#: The base patterns. Where a repeated part can't give anything back to what follows, it is possessive, so long
#: runs need neither stack nor a second look; a match can only begin where a run begins or a match has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that could be an identifier: it has a digit or an at sign.
LOOSE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Code points of context looked at on either side.
REACH = 60
#: Tokens that a candidate can join by single spaces.
RUN = 5


def _present(text: Column, kind: str) -> Column:
    """A cheap test that must hold for any match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9@]" if kind == "loose" else "[0-9]")


def _near(side: Column, last: bool) -> Column:
    """The part of a side's text that is looked at."""
    return F.substring(side, -REACH, REACH) if last else F.substring(side, 1, REACH)


def _words(side: Column, last: bool) -> Column:
    """Up to two words next to the slot, lower-cased, without punctuation, nearest first; _ stands for the border of the text."""
    words = F.regexp_extract_all(F.lower(_near(side, last)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    words = F.reverse(words) if last else words
    return F.slice(F.concat(words, F.array(F.lit("_"), F.lit("_"))), 1, 2)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<gap, n, match, before, after>>: leftmost matches that don't overlap, with the code points
    since the previous match, their own length and the text before and after each up to the second match away."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h"))
    return F.transform(F.when(F.size(found) > 0, both), lambda x: F.struct(
        F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("match"), _near(x["g"], True).alias("before"), _near(x["h"], False).alias("after")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 3) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))
    return (F.when(kind == "ip", small).when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
            .when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """Matches of one column as rows (row, i, start, end, match, before, after); code points, end exclusive. before and
    after are the text around, other matches included: any two of them hold two words."""
    each = rows.select("row", F.posexplode(column).alias("i", "m")).select("row", "i", "m.*")
    order = Window.partitionBy("row").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    piece = lambda k: F.coalesce(F.lag(F.concat("before", "match"), k).over(order), F.lit(""))
    rest = lambda k: F.coalesce(F.lead(F.concat("match", "after"), k).over(order), F.lit(""))
    return each.select("row", "i", (end - F.col("n")).alias("start"), end.alias("end"), "match", _near(F.concat(piece(2), piece(1), "before"), True).alias("before"),
                       _near(F.concat("after", rest(1), rest(2)), False).alias("after"))


def _worded(slots: DataFrame) -> DataFrame:
    """Slots with the words around in place of the text."""
    return slots.withColumns({"left": _words(F.col("before"), True), "right": _words(F.col("after"), False)}).drop("before", "after")


def _runs(tokens: DataFrame) -> DataFrame:
    """Every run of up to RUN tokens that single spaces join, with the number of runs that begin where it
    begins (same_left) and end where it ends (same_right). Punctuation at a token's end ends a run."""
    order = Window.partitionBy("row").orderBy("i")
    tokens = tokens.withColumn("glued", F.col("before").rlike(r"[0-9A-Za-z)]\x20$") & (F.lag("end").over(order) == F.col("start") - 1))
    glued = lambda k: F.coalesce(F.lead("glued", k).over(order) if k > 0 else F.lag("glued", -k).over(order) if k else F.col("glued"), F.lit(False))
    reach = lambda ks: sum(((F.lit(True) if not upto else F.forall(F.array(*upto), lambda g: g)).cast("int") for upto in ([F.col(f"_g{j + 50}") for j in ks[:n]] for n in range(RUN))), F.lit(0))
    wide = tokens.withColumns({f"_g{k + 50}": glued(k) for k in range(2 - RUN, RUN)})
    wide = wide.withColumns({"ahead": reach(list(range(1, RUN))), "behind": reach([-k for k in range(RUN - 1)])})
    tail = lambda name, k: F.lead(name, k).over(order) if k else F.col(name)
    ends = F.array(*[F.struct(tail("end", k).alias("end"), tail("after", k).alias("after"), F.concat_ws(" ", *[tail("match", j) for j in range(k + 1)]).alias("match"),
                              tail("behind", k).alias("same_right")) for k in range(RUN)])
    wide = wide.withColumn("_ends", ends).select("row", "start", "before", F.col("ahead").alias("same_left"), F.explode(F.slice("_ends", F.lit(1), F.col("ahead"))).alias("e"))
    return wide.select("row", "start", "before", "same_left", "e.*")


def _bare(tokens: DataFrame) -> DataFrame:
    """Tokens without the punctuation around them."""
    head = F.length(F.regexp_extract("match", "^[^0-9A-Za-z+(]*", 0))
    core = F.regexp_replace(F.expr("substring(match, head + 1)"), r"(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", "")
    tokens = tokens.withColumn("head", head).withColumn("core", core).where(F.length("core") >= 4)
    return tokens.select("row", (F.col("start") + F.col("head")).alias("start"), (F.col("start") + F.col("head") + F.length("core")).alias("end"), F.col("core").alias("match"),
                         F.concat("before", F.expr("substring(match, 1, head)")).alias("before"), F.concat(F.expr("substring(match, head + length(core) + 1)"), "after").alias("after"),
                         "same_left", "same_right")


def _contexts(slots: DataFrame) -> DataFrame:
    """A row for each lexical pattern of a slot: two words on the left, two on the right, or one on each side."""
    left, right = F.col("left"), F.col("right")
    return slots.withColumn("pattern", F.explode(F.array(
        F.struct(F.concat(F.lit("L:"), left[1], F.lit(" "), left[0]).alias("pattern"), (1 / F.col("same_left")).alias("part")),
        F.struct(F.concat(F.lit("R:"), right[0], F.lit(" "), right[1]).alias("pattern"), (1 / F.col("same_right")).alias("part")),
        F.struct(F.concat(F.lit("B:"), left[0], F.lit(" "), right[0]).alias("pattern"), F.lit(1.0).alias("part"))))).select("match", "pattern.*")


def discovered(seeds: DataFrame, tokens: DataFrame, rounds: int = 3, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """(match, kind, score) of the tokens that the contexts vouch for.

    seeds: kind, match, left, right; tokens: match, left, right, same_left, same_right. Runs that begin at one place
    are one slot of what stands left of it, and share it; so on the right. Slots are counted per (pattern, instance)
    before anything is joined, so a context or an instance in a third of all rows is one row. A pattern counts
    for a kind if its good instances of that kind are at least min_support different ones, with a share of at
    least min_confidence in its slots (one slot is added to the whole as doubt)."""
    alone = seeds.select("match", "left", "right", F.lit(1).alias("same_left"), F.lit(1).alias("same_right"))
    edges = _contexts(alone.unionByName(tokens.select("match", "left", "right", "same_left", "same_right"))).groupBy("pattern", "match").agg(F.sum("part").alias("n"))
    edges = staged(edges)
    slots = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    sure = staged(seeds.select("match", "kind").distinct().withColumn("score", F.lit(1.0)))
    scores = sure
    for _ in range(rounds):
        good = edges.join(scores, "match").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("held"), F.sum((F.col("score") >= min_confidence).cast("int")).alias("support"))
        good = good.where(F.col("support") >= min_support).join(slots, "pattern").withColumn("trust", F.col("held") / (F.col("all") + 1)).where(F.col("trust") >= min_confidence)
        doubt = edges.join(good.select("pattern", "kind", "trust"), "pattern").groupBy("match", "kind").agg(F.sum(F.log(1.0 - F.col("trust"))).alias("doubt"))
        grown = doubt.select("match", "kind", (1.0 - F.exp("doubt")).alias("score"))
        scores = staged(sure.unionByName(grown).groupBy("match", "kind").agg(F.max("score").alias("score")))
    found = scores.join(sure.select("match").distinct(), "match", "left_anti").where(F.col("score") >= min_confidence)
    return found.groupBy("match").agg(F.max(F.struct("score", "kind")).alias("best")).select("match", "best.kind", "best.score")


def _text_of(spans: Column) -> Column:
    """kind:start:end by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column) -> Column:
    """Spans that don't overlap: the best score first, then the longest, then the leftmost."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((-F.round(s["score"], 9)).alias("z"), (s["span"]["start"] - s["span"]["end"]).alias("n"), s["span"].alias("s"))))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return F.aggregate(ordered, none, lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["s"]["end"]) & (k["end"] > x["s"]["start"])), kept).otherwise(F.concat(kept, F.array(x["s"]))))


def personal_data(df: DataFrame, id_col: str, text: str, rounds: int = 3, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (of the base patterns), base (the spans of
    the base patterns as text), spans (all, with those that contexts found).

    Base matches are leftmost and don't overlap within a kind; those that fail the kind's test are dropped
    without another try. Spans found by context never overlap base ones. Null text counts as empty. Repeated rows are rows of
    their own; null ids are carried; an empty table gives an empty table; other columns may have any name."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), *[F.when(_present(value, k), matches(value, p)).alias(k) for k, p in {**PATTERNS, "loose": LOOSE}.items()])
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    base = None
    for kind in KINDS:
        one = _worded(_placed(rows, kind).drop("i")).where(_valid(F.lit(kind), F.col("match"))).withColumn("kind", F.lit(kind))
        base = one if base is None else base.unionByName(one)
    base = staged(base)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    span = F.struct(F.col("start").cast("bigint").alias("start"), number.alias("kind"), F.col("end").cast("bigint").alias("end"))
    # As many spans as a document has.
    of_row = base.groupBy("row").agg(F.collect_list(span).alias("base"))
    tokens = _worded(_bare(_runs(_placed(rows, "loose")))).join(of_row, "row", "left")
    tokens = tokens.where(~F.coalesce(F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))), F.lit(False)))
    tokens = staged(tokens.select("row", "start", "end", "match", "left", "right", "same_left", "same_right"))
    new = tokens.join(discovered(base, tokens, rounds, min_support, min_confidence), "match")
    more = new.groupBy("row").agg(_apart(F.collect_list(F.struct("score", span.alias("span")))).alias("more"))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    full = rows.select("row", "id").join(of_row, "row", "left").join(more, "row", "left").withColumns({"base": F.coalesce("base", none), "more": F.coalesce("more", none)})
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return full.select(F.col("id").alias(id_col), *counts, _text_of(F.col("base")).alias("base"), _text_of(F.concat("base", "more")).alias("spans"))
