"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, mid-sentence names and units of measure become typed placeholders; windows of the resulting templates are
hash-joined; the values behind the placeholders must then map one to one, so that re-parameterised copies of a
question are found and chance meetings of templates are not. Matches of several alignments near each other count
together, so a word put in or left out doesn't hide the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Template tokens in a window.
WINDOW = 5
#: Items of fewer template tokens are no evidence of a leak and are left out.
LEAST = 5
#: Windows with fewer words that are not placeholders are too general to count; an item that has only such is one window.
LITERALS = 2
#: An item of fewer words that are not placeholders must be met with its own values.
FREE = 2
#: Share of an item's tokens (as far as its windows reach) that a document must hold, consistent, to count as a leak,
#: and a number of tokens that are enough only if they are that share; of items up to it all but one are asked for.
SHARE, ENOUGH = 0.5, 8
#: Benchmarks of up to so many distinct windows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Units that are a placeholder after a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "miles", "mile", "mg", "g", "kg", "tons", "pounds", "ml", "l", "litres", "liters", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "percent", "degrees")
#: A word: letters and digits, joined by single inner points, commas or apostrophes. Repeated groups are possessive, which changes no match
#: here: Java takes other repeated groups by recursion, which long runs end with a full stack.
WORD = r"[\p{L}\p{N}]+(?:[.,'’][\p{L}\p{N}]+)*+"
REST = r"[\p{L}\p{N}]*(?:[.,'’][\p{L}\p{N}]+)*+"
#: Capitalised words inside a sentence, one name each run; a word that begins with a digit; a unit after a number.
NAME = r"(?<=[\p{L}\p{N},;:]\s)\p{Lu}\p{Ll}" + REST + r"(?:\s\p{Lu}\p{Ll}" + REST + ")*+"
NUMBER = r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][.,'’])[0-9]" + REST
UNIT = r"(?<=<num>\s)(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])(?![.,'’][\p{L}\p{N}])"
TOKEN = r"<(?:num|name|unit)>|" + WORD
PLACEHOLDERS = ("<num>", "<name>", "<unit>")


def _plain(text: Column) -> Column:
    """The text without what would look like a placeholder."""
    return F.when(F.instr(text, "<") > 0, F.regexp_replace(text, r"<(num|name|unit)>", "$1")).otherwise(text)


def _words(text: Column) -> Column:
    """The words of a text (the whole of a name) as they stand in it, one for each template token."""
    return F.regexp_extract_all(text, F.lit(f"{NAME}|{WORD}"), F.lit(0))


def _template(text: Column) -> Column:
    """Template tokens: a placeholder or a word in lower case. A placeholder stands for one whole word or name, so
    tokens and words have the same places."""
    low = F.lower(F.regexp_replace(_plain(text), NAME, "<name>"))
    typed = F.when(low.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(low, NUMBER, "<num>"), UNIT, "<unit>")).otherwise(low)
    return F.regexp_extract_all(typed, F.lit(TOKEN), F.lit(0))


def _hashed(n: int):
    return lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(n)))


def _windows(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """One row per window of ``df(tokens)``: the columns ``keep``, pos (from 0), n, h (64-bit hash of its tokens).

    Outer explode and no filter on the arrays: either would have the optimizer compute them a second time, to test them.
    """
    rows = df.withColumn("hashes", F.transform("tokens", lambda x: F.xxhash64(x)))

    def windows(n: int) -> Column:
        return F.when(F.size("hashes") >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size("hashes") - n, F.lit(0))), _hashed(n)))

    out = [rows.select(*keep, F.posexplode_outer(windows(n)).alias("pos", "h")).withColumn("n", F.lit(n)).filter("h IS NOT NULL") for n in lengths]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def _slots(tokens: Column, words: Column, pos: Column, n: Column) -> Column:
    """Placeholder values of one window, in order of their place in it."""
    tokens, words = F.slice(tokens, pos + 1, n), F.slice(words, pos + 1, n)
    both = F.filter(F.arrays_zip(tokens.alias("t"), words.alias("r")), lambda x: x["t"].isin(*PLACEHOLDERS))
    return F.transform(both, lambda x: F.concat_ws(" ", x["t"], x["r"]))


def _literals(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: ~x.isin(*PLACEHOLDERS)))


def benchmark_windows(bench: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(item_id, item_pos, n, h, item_slots, own, n_windows, n_tokens)`` of every item, and the window lengths that occur.

    ``n_tokens`` counts the item's tokens in windows; ``own`` says that only the item's own values count. Where an item begins
    with a capital letter, its first window also comes with a name there, for that word may be one in a document.
    """
    items = bench.select("item_id", F.col("text").alias("t")).filter("t is not null").distinct().withColumn("tokens", _template(F.col("t"))).filter(F.size("tokens") >= LEAST)
    rich = F.exists(F.sequence(F.lit(1), F.size("tokens") - WINDOW + 1), lambda i: _literals(F.slice(F.col("tokens"), i, F.lit(WINDOW))) >= LITERALS)
    items = saved(items.withColumn("length", F.when(rich, F.lit(WINDOW)).otherwise(F.size("tokens"))))
    lengths = sorted({WINDOW} | {r[0] for r in items.select("length").distinct().collect()})  # lengths of items
    named = F.col("t").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}") & ~F.col("tokens")[0].isin(*PLACEHOLDERS)
    other = F.concat(F.array(F.lit(PLACEHOLDERS[1])), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))))
    items, keep = items.withColumn("made", F.lit(0)), ["item_id", "length", "made", "t", "tokens"]
    rows = _windows(items, keep, lengths).unionByName(_windows(items.filter(named).withColumn("tokens", other).withColumn("made", F.lit(1)), keep, lengths).filter("pos = 0"))
    literals = _literals(F.slice("tokens", F.col("pos") + 1, F.col("n"))) + F.col("made")
    rows = rows.filter((F.col("n") == F.col("length")) & ((literals >= LITERALS) | (F.size("tokens") == F.col("n"))))
    rows = saved(rows.select("item_id", F.col("pos").alias("item_pos"), "n", "h", _slots(F.col("tokens"), _words(_plain(F.col("t"))), F.col("pos"), F.col("n")).alias("item_slots"), ((F.size("tokens") == F.col("n")) & (literals < FREE)).alias("own")))
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence("item_pos", F.col("item_pos") + F.col("n") - 1))))
    total = rows.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows"), F.size(places).alias("n_tokens"))
    return rows.join(total, "item_id"), lengths


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, n_conflicts, share)``: the documents that hold a benchmark item.

    A document holds an item where matched windows cover at least SHARE of the item's tokens (see ENOUGH) and no
    placeholder value of the item stands for two values of the document. The windows are those of one alignment (the
    same shift between their places), or of several whose shifts differ by at most half the item's length: the
    alignment of most tokens first, then each that agrees with those before it. An alignment that contradicts
    itself counts for nothing. Whole texts are read; null and empty texts hold nothing; null items are skipped, repeated
    item rows count once, repeated document rows give the same pair once. Items of under LEAST tokens are skipped.
    The result has each pair once, by its best place (most tokens, then the earliest shift). Other columns aren't
    read. Empty tables give an empty result.
    """
    windows, lengths = benchmark_windows(bench)
    windows = saved(windows)
    n = windows.count()
    texts = docs.select("doc_id", F.col("text").alias("t")).filter("t <> ''").withColumn("row", F.xxhash64("doc_id", "t"))
    known = windows.select("h").distinct()
    found = _windows(texts.withColumn("tokens", _template(F.col("t"))), ["row"], lengths).join(F.broadcast(known) if n <= MAX_BROADCAST else known, "h", "left_semi")
    hits = saved(found.select("row", "pos", "n", "h").distinct().groupBy("row").agg(F.collect_list(F.struct("pos", "n", "h")).alias("hits")))
    # Texts with hits alone are read again; a row holds a text once, however many windows were hit. Hits grow with the texts, so they
    # aren't sent to all tasks at any size.
    held = saved(texts.join(hits.hint("merge"), "row").select("doc_id", "hits", _template(F.col("t")).alias("tokens"), _words(_plain(F.col("t"))).alias("words")))
    slots = F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), _slots(F.col("tokens"), F.col("words"), x["pos"], x["n"]).alias("slots")))
    placed = held.select("doc_id", F.explode(slots).alias("x")).select("doc_id", "x.*")
    met = saved(placed.join(windows, "h").filter(~F.col("own") | (F.col("item_slots") == F.col("slots")))).withColumn("shift", F.col("pos") - F.col("item_pos"))
    key = ["doc_id", "item_id", "n_windows", "n_tokens"]
    sets = [F.collect_set(x) for x in ("item_pos", F.sequence("item_pos", F.col("item_pos") + F.col("n") - 1), F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))]
    runs = met.groupBy(*key, "shift").agg(sets[0].alias("at"), F.array_distinct(F.flatten(sets[1])).alias("held"), F.array_distinct(F.flatten(sets[2])).alias("pairs"))
    runs = runs.filter(F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs"))
    half = F.greatest(F.floor(F.col("n_tokens") / 2), F.lit(1))
    grid = F.floor(F.col("shift") / half)
    near = runs.withColumn("cell", F.explode(F.array(grid, grid - 1)))  # two halves make a cell; each half is in two cells
    run = F.struct((-F.size("held")).alias("order"), "shift", "at", "held", "pairs")
    near = near.groupBy(*key, "cell").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    agrees = lambda x, y: ~F.exists(x, lambda p: F.exists(y, lambda q: (p["a"] == q["a"]) & (p["b"] != q["b"])))

    def add(acc: Column, x: Column) -> Column:
        both = F.struct(*(F.array_union(acc[c], x[c]).alias(c) for c in ("at", "held", "pairs")))
        return F.when(agrees(acc["pairs"], x["pairs"]), both).otherwise(acc)

    first = F.struct(*(F.col("runs")[0][c].alias(c) for c in ("at", "held", "pairs")))
    out = near.withColumn("x", F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(1))), first, add)).withColumn("n_held", F.size("x.held"))
    need = F.greatest(F.ceil(F.col("n_tokens") * SHARE), F.least(F.col("n_tokens") - 1, F.lit(ENOUGH)))
    out = out.filter(F.col("n_held") >= need).withColumn("n_matched", F.size("x.at").cast("long"))
    out = out.withColumn("n_conflicts", F.lit(0).cast("long")).withColumn("share", F.col("n_held") / F.col("n_tokens"))
    best = F.max_by(F.struct("n_windows", "n_matched", "n_conflicts", "share"), F.struct("n_held", -F.col("runs")[0]["shift"]))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose document holds no benchmark item. Rows of a null id
    that hold one take all rows of a null id with them."""
    bad = leaks(docs, bench).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]), "left_anti")


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
