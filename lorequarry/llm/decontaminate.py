"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question that was given other figures or names keeps its
template. Windows of template tokens are hash-joined with those of the benchmark. For documents that share enough of an
item, the values in the placeholders are compared: a re-parameterised copy maps equal values to equal values.

A text is read in two ways (``VIEWS``) that don't hang on what stands around an item: without names, in lower case, which
finds copies in any case and those with other figures; and with every capitalised word as a name, which finds those with
other names. Items are read in each way that their first words can be read in after other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, large, small, unused

#: Template tokens of a window; a shorter item is one window of its own length.
WINDOW = 8
#: An item of fewer tokens can't be told from ordinary prose and is never reported.
MIN_TOKENS = 4
#: A document holds an item if windows cover this share of its tokens, or this many tokens.
MIN_COVER, ENOUGH_TOKENS = 0.5, 25
#: Whatever share of the item it is, a run of so many tokens that are the same, figures included, is held.
VERBATIM_RUN = 13
#: Tokens besides placeholders that must agree where item and document are aligned, unless all tokens of the item do.
MIN_LITERALS = 3
#: Least consistency of the placeholders' values: 1 if they map one to one.
MIN_CONSISTENCY = 0.75

# Marks from the private use area: number, name, unit, and the end of a value.
NUMBER, NAME, UNIT, END = "\ue000", "\ue001", "\ue002", "\ue00f"

# Words for numbers, and units that may follow a number.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in yd l ml gal s sec min h hr ms hz khz mhz ghz w kw mw v a ohm j kj cal kcal n pa kpa bar mol kb mb gb tb c f "
    "kilograms kilogram grams gram pounds pound ounces ounce kilometers kilometer kilometres kilometre meters meter metres metre centimeters centimeter centimetres centimetre millimeters "
    "miles mile feet foot inches inch yards yard liters liter litres litre gallons gallon seconds second minutes minute hours hour days day weeks week months month years year "
    "dollars dollar cents cent euros euro percent degrees degree watts watt volts volt mph kmh"
).split()
#: Capitalised words that begin sentences and are no names; so are the words that the benchmark has in lower case.
STARTERS = (
    "a an the this that these those there it he she they we you i his her their its our my your if in on at of for from to by with as and or but when while after before then each every all some one no not "
    "what which who whom whose where why how is are was were do does did has have had can could will would should may might must let find given calculate compute determine solve show prove write explain describe name choose select consider suppose assume "
    "der die das ein eine wer wie wo wann warum welche welcher welches und ist sind wenn es er sie wir le la les un une des qui que quel quelle quels quelles comment où quand pourquoi si il elle el los las una qué cuál cuánto cómo dónde cuándo quién"
).split()
# groups are repeated possessively: the regex engine recurses for each repetition of others, and long runs end the stack
FIGURES = r"[$€£¥]?\d+(?:[.,:/]\d+)*+%?"
_PROPER = r"\p{Lu}\p{Ll}[\p{L}\p{M}'’-]*"
#: A capitalised word or several, wherever it stands.
NAMES = r"(^|[^\p{L}\p{M}])(" + _PROPER + r"(?: " + _PROPER + r")*+)"
#: No names, in any case; every capitalised word a name.
PLAIN, CAPITALS = VIEWS = ("plain", "capitals")
WORDS = r"[\p{L}\p{M}][\p{L}\p{M}'’-]*"
SPLIT = rf"[^\p{{L}}\p{{M}}{NUMBER}-{UNIT}]+"
VALUES = rf"[{NUMBER}-{UNIT}][^{END}]*|[\p{{L}}\p{{M}}]+"


def _mark(text: Column, values: bool, view: str) -> Column:
    v = lambda k: f"${k}" if values else ""
    text = F.regexp_replace(text, FIGURES, f" {NUMBER}{v(0)}{END} ")
    if view == CAPITALS:
        text = F.regexp_replace(text, NAMES, f"$1 {NAME}{v(2)}{END} ")
    return F.lower(text)


def _typed(tokens: str, values: bool) -> Column:
    """Words for numbers, and units after a number, as placeholders. ``tokens`` names a column: an expression would be
    computed again for every token."""
    word = lambda t: t.isin(*NUMBER_WORDS)
    before = lambda i: F.get(F.col(tokens), i - 1)
    mark = lambda m, t: F.concat(F.lit(m), t) if values else F.lit(m)
    unit = lambda t, i: t.isin(*UNITS) & F.coalesce(F.startswith(before(i), F.lit(NUMBER)) | word(before(i)), F.lit(False))
    # one look-up tells that most tokens are neither
    return F.transform(tokens, lambda t, i: F.when(~t.isin(*NUMBER_WORDS, *UNITS), t).when(word(t), mark(NUMBER, t)).when(unit(t, i), mark(UNIT, t)).otherwise(t))


def with_template(rows: DataFrame, text: str, name: str, view: str) -> DataFrame:
    """``rows`` with an array of tokens: runs of letters in lower case, and placeholders."""
    return rows.withColumn("_raw", F.array_remove(F.split(_mark(F.col(text), False, view), SPLIT), "")).withColumn(name, _typed("_raw", False)).drop("_raw")


def with_values(rows: DataFrame, text: str, name: str, view: str) -> DataFrame:
    """The same tokens, with the value after each placeholder."""
    return rows.withColumn("_raw", F.regexp_extract_all(_mark(F.col(text), True, view), F.lit(VALUES), F.lit(0))).withColumn(name, _typed("_raw", True)).drop("_raw")


def _item_readings(items: DataFrame) -> DataFrame:
    """``items(item_id, item_text)`` -> a row for each way to read an item: ``view``, ``wording`` after the ``skip``
    tokens before it, ``tokens``, and ``common``: those of its capitalised words that are no names.

    After a number a first word can be a unit, and within a sentence it can be in lower case.
    """
    found = items.select("item_text", F.explode(F.regexp_extract_all("item_text", F.lit(WORDS), F.lit(0))).alias("word"))
    lower = found.where(F.col("word").rlike(r"^\p{Ll}")).select("word")
    lower = lower.union(items.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STARTERS))))).distinct()
    capital = found.where(F.col("word").rlike(r"^\p{Lu}")).select("item_text", F.lower("word").alias("word")).distinct()
    common = capital.join(lower, "word", "left_semi").groupBy("item_text").agg(F.collect_set("word").alias("common"))
    items = items.join(common, "item_text", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    text = F.col("item_text")
    first_lower = F.concat(F.lower(F.substring(text, 1, 1)), F.expr("substring(item_text, 2)"))
    ways = [(PLAIN, text, 0), (PLAIN, F.concat(F.lit("5 "), text), 1), (CAPITALS, text, 0), (CAPITALS, first_lower, 0)]
    read = None
    for view, wording, skip in ways:
        part = items.select("item_id", "item_text", "common", F.lit(view).alias("view"), F.lit(skip).alias("skip"), wording.alias("wording"))
        part = with_template(part, "wording", "tokens", view).withColumn("tokens", F.expr("slice(tokens, skip + 1, greatest(size(tokens) - skip, 0))"))
        read = part if read is None else read.unionByName(part)
    # readings that don't differ are one: the first
    again = Window.partitionBy("item_id", "view", "item_text", "tokens").orderBy("skip", "wording")
    return read.withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again", "item_text")


def _shape(token: Column) -> Column:
    return F.when(token < F.lit(NUMBER), token).when(token > F.lit(END), token).otherwise(F.substring(token, 1, 1))


def _grams(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grams``, the hashes of all runs of MIN_TOKENS tokens, in order."""
    rows = rows.withColumn("_t", F.transform("tokens", lambda t: F.xxhash64(t)))
    n = F.size("_t") - MIN_TOKENS
    at = lambda i: F.xxhash64(*[F.get(F.col("_t"), i + k) for k in range(MIN_TOKENS)])
    grams = F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("grams", grams).drop("_t")


def _window(first: Column, last: Column) -> Column:
    """A window's hash: that of its first and last runs."""
    return F.xxhash64(first, last)


def _in_views(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, view, tokens``: each text is scanned once for its figures."""
    raw = lambda c: F.array_remove(F.split(F.lower(c), SPLIT), "")
    rows = docs.select("doc_id", F.regexp_replace("text", FIGURES, f" {NUMBER}{END} ").alias("_text"))
    both = F.array(
        F.struct(F.lit(PLAIN).alias("view"), raw(F.col("_text")).alias("raw")),
        F.struct(F.lit(CAPITALS).alias("view"), raw(F.regexp_replace("_text", NAMES, f"$1 {NAME}{END} ")).alias("raw")),
    )
    rows = rows.select("doc_id", F.inline(both))
    return rows.withColumn("tokens", _typed("raw", False)).drop("raw")


def _sized(items: DataFrame) -> DataFrame:
    """Written ``items(wording, common, ...)``, marked for the join by the counted length of the texts."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("wording") + F.octet_length(F.concat_ws("", "common")) + 24 * F.size("common")), F.lit(0))).first()
    return small(items, 64 + size // max(n, 1))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> a row for each document and item that it holds:
    ``doc_id, item_id, n_tokens, n_covered, n_slots, kind``.

    ``n_tokens`` are the item's, ``n_covered`` those within shared windows, ``n_slots`` the placeholders where item and
    document are aligned best. ``kind`` is ``verbatim`` if their values agree and ``reparameterised`` if they differ
    consistently; others are not reported. Rows without a doc_id, and null or empty texts, hold nothing. Rows sharing a
    doc_id are one document, and rows sharing an item_id alternative wordings of one item. Other columns are not looked
    at. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    docs = docs.select("doc_id", F.col("text").cast("string")).where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    items = _item_readings(items).withColumn("n_tokens", F.size("tokens")).where(F.col("n_tokens") >= MIN_TOKENS)
    items = items.withColumn("version", F.xxhash64("view", "wording")).withColumn("width", F.least("n_tokens", F.lit(WINDOW)))
    items = ws.save(_grams(items), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WINDOW numbers
    if not widths:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", "n_tokens", F.lit(0).alias("n_covered"), F.lit(0).alias("n_slots"), F.lit("").alias("kind"))
    sought = items.select("item_id", "view", "version", "width", "grams", F.posexplode("grams").alias("item_pos", "g"))
    sought = sought.withColumn("last", F.get("grams", F.col("item_pos") + F.col("width") - MIN_TOKENS)).where("last is not null")
    sought = ws.save(sought.select("item_id", "view", "version", "width", "item_pos", "g", _window(F.col("g"), F.col("last")).alias("h")), "windows")
    begins = ws.save(sought.select("g").distinct(), "begins")
    seen = _grams(_in_views(docs)).select("doc_id", "view", "grams")
    # a window is its first run of tokens and the runs at which one of each width ends
    ends = F.transform("grams", lambda g, i: F.struct(g.alias("g"), *[F.get(F.col("grams"), i + (w - MIN_TOKENS)).alias(f"w{w}") for w in widths]))
    seen = seen.select("doc_id", "view", F.posexplode(ends).alias("pos", "e")).select("doc_id", "view", "pos", "e.*")
    seen = seen.join(small(begins, 16), "g", "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), _window(F.col("g"), F.col(f"w{w}")).alias("h"), F.col(f"w{w}").alias("last")) for w in widths]))
    seen = seen.select("doc_id", "view", "pos", each.alias("e")).select("doc_id", "view", "pos", "e.*").where("last is not null").drop("last")
    hits = seen.join(small(sought, 64), ["h", "width", "view"]).select("doc_id", "item_id", "version", "width", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    # windows of one alignment, then all alignments of a document and an item
    by_shift = hits.groupBy("doc_id", "item_id", "version", "width", "shift").agg(F.count("*").alias("n"), F.collect_set("item_pos").alias("at"))
    by_item = by_shift.groupBy("doc_id", "item_id", "version", "width").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    reach = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s["n"] + F.col("width") - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + F.col("width")).alias("end")))["n"]
    held = by_item.withColumn("n_covered", reach).drop("at", "width").join(_sized(items.select("item_id", "version", "view", "skip", "common", "n_tokens", "wording")), ["item_id", "version"])
    held = ws.save(held.where((F.col("n_covered") >= F.col("n_tokens") * MIN_COVER) | (F.col("n_covered") >= ENOUGH_TOKENS) | ((F.col("view") == PLAIN) & (F.col("n_covered") >= VERBATIM_RUN))), "held")
    wanted = ws.save(held.select("doc_id", "view").distinct(), "wanted")
    both = None
    for view in VIEWS:
        texts = with_values(docs.join(small(wanted.where(F.col("view") == view).select("doc_id"), 16), "doc_id"), "text", "theirs", view).select("doc_id", "theirs")
        part = texts.join(large(with_values(held.where(F.col("view") == view), "wording", "ours", view)), "doc_id")
        both = part if both is None else both.unionByName(part)
    both = both.withColumn("ours", F.expr("slice(ours, skip + 1, size(ours))"))
    aligned = F.filter(
        F.transform("ours", lambda x, i: F.struct(x.alias("x"), F.get(F.col("theirs"), F.col("shift") + i).alias("y"), i.alias("i"))),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (_shape(p["x"]) == _shape(p["y"])),
    )
    both = both.withColumn("aligned", aligned)
    # a word that is no name, though it is read as one, is held only by itself
    word = lambda p: F.substring_index(p["x"].substr(F.lit(2), F.length(p["x"])), " ", 1)
    other = lambda p: p["x"].startswith(NAME) & F.array_contains("common", word(p)) & ~F.array_contains(F.split(p["y"].substr(F.lit(2), F.length(p["y"])), " "), word(p))
    both = both.where(~F.exists("aligned", other))
    slots = F.filter("aligned", lambda p: p["x"].between(F.lit(NUMBER), F.lit(END)))
    both = both.withColumn("slots", slots)
    pairs, ours, theirs = (F.size(F.array_distinct(c)) for c in (F.transform("slots", lambda p: F.struct(p["x"], p["y"])), F.col("slots.x"), F.col("slots.y")))
    both = both.withColumn("consistency", F.when(F.size("slots") == 0, 1.0).otherwise((ours + theirs) / (2 * pairs)))
    same = F.transform("ours", lambda x, i: F.coalesce(x == F.get(F.col("theirs"), F.col("shift") + i), F.lit(False)))
    grown = lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(x, s["now"] + 1).otherwise(0)).alias("most"))
    both = both.withColumn("run", F.aggregate(same, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), grown, lambda s: s["most"]))
    all_same, long_run = F.col("run") == F.col("n_tokens"), (F.col("view") == PLAIN) & (F.col("run") >= VERBATIM_RUN)
    share = (F.col("n_covered") >= F.col("n_tokens") * MIN_COVER) | (F.col("n_covered") >= ENOUGH_TOKENS)
    copied = share & (F.col("consistency") >= MIN_CONSISTENCY) & (F.size("aligned") - F.size("slots") >= MIN_LITERALS)
    both = both.where(copied | all_same | long_run)
    kind = F.when(F.exists("slots", lambda p: p["x"] != p["y"]) & copied, "reparameterised").otherwise("verbatim")
    both = both.select("doc_id", "item_id", "n_tokens", "n_covered", F.size("slots").alias("n_slots"), kind.alias("kind"))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_covered"), "n_tokens", F.desc("kind"), "n_slots")
    return both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of the benchmark. Rows without a doc_id stay."""
    ws = Workspace(docs.sparkSession, "leaks-clean")
    gone = unused("_lost", docs)
    lost = ws.save(find_leaks(docs, benchmark).select(F.col("doc_id").alias(gone)).distinct(), "lost")
    return docs.join(small(lost, 16), F.col("doc_id") == F.col(gone), "left_anti")
