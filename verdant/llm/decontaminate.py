"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

A text is read in two ways. Numbers are typed slots in both, whatever else is a
lower-case word without punctuation. Plainly, capitalised words inside a
sentence are name slots, one each. Merged, those that begin a sentence are
names, too, a run of names is one slot, and a number takes the unit-like word
after it into its slot: any word of any language that isn't a function word or
capitalised. So names of several words and units that no list has are slots.

A document is contaminated by an item if, in one reading, a window of
``RUN_TOKENS`` template tokens (or a whole shorter item) is common to both, and
either all its slots have the same values or at most half of its tokens are
slots and their values are consistent: one document value for each item value,
numbers and units by themselves; a unit that only one side has is no evidence. Merged, the unit-like word after
"how many" is a slot with a unit and no number; it counts as a word where slots are held against half of the tokens.
Thus the same question with other numbers, names or units is found, whatever
comes before and after, and a chance likeness of slots isn't.

Every run of ``RUN_TOKENS`` tokens holds a window of ``WINDOW`` tokens that
begins at a multiple of ``STRIDE`` in the document, so only those windows of a
document are hashed and joined with all windows of the items. Items are few;
what is broadcast of them is counted first, and shuffled beyond a bound. Only
documents that meet an item's window are compared in full, where they meet it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import free_name, written

RUN_TOKENS, WINDOW = 13, 8
#: Shorter items are left out; 1 keeps all that have a token.
LEAST_TOKENS = 1
#: Of a window's tokens so many hundredths at least must be no slots, unless it is verbatim.
LEAST_WORD_PERCENT = 50
#: Item windows (some 30 bytes each) and item tokens up to these numbers are broadcast.
MOST_BROADCAST, MOST_BROADCAST_TOKENS = 500_000, 1_000_000
# Function words, which are no units.
FUNCTION_WORDS = {
    "en": "a am an and are as at be but by for from had has he her his how i if in is it its no not of off on or our out she so than that the their them then there they this to was we were what when which who will with you your".split(),
    "de": "als am an auf aus bei das dass dem den der des die durch ein eine er es für hat ich im in ist mit nach nicht oder sein sich sie sind so über um und von vor war was wenn wie wir zu zum zur".split(),
    "fr": "à au aux ce ces cette dans de des donc du elle en est et il ils je la le les leur mais ne nous ont ou où par pas pour que qui sa se ses son sont sur un une vous y".split(),
    "es": "a al como con cuando de del el ella en era es esta este fue ha la las le lo los más no o para pero por que se si sin son su sus un una y ya".split(),
}
# Words that ask for a number, before a unit.
HOW_MANY = {"en": ["how many"], "de": ["wie viele"], "fr": ["combien de"], "es": ["cuántos", "cuántas"]}
# Slots begin with a private-use character; such characters in a text are read as these.
NUMBER, UNIT, NAME, POINT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: Characters of a token, less the brackets of a class.
TOKEN = rf"a-z\p{{L}}\p{{N}}{NUMBER}-{JOIN}%$€£"
#: A word after a number that may be a unit: no name (a capital and small letters), no function word.
UNIT_LIKE = r"(?:\p{Ll}\p{L}*|\p{Lu}{2,4}\p{Ll}?|[A-HJ-Z])"
# Repeated groups are possessive: Java matches those in a loop, others by a recursion that a long run overflows, which ends the executor.
_NUMBERS = rf"\d(?:[\d{POINT}]|[.,](?<=\d[.,])(?=\d))*+"
_NAMES = rf"\p{{Lu}}(?<=(?:[\p{{Ll}}\p{{Nd}},;{NUMBER}]|[\p{{Nd}}{NUMBER}]\s)\s\p{{Lu}})\p{{Ll}}+"
_CAPITALS = rf"\p{{Lu}}(?<![{TOKEN}]\p{{Lu}})(?=\p{{Ll}})"
_WORD = rf"(?!(?i:{'|'.join(sorted({w for words in FUNCTION_WORDS.values() for w in words}))})(?![{TOKEN}])){UNIT_LIKE}(?![{TOKEN}])"
_UNIT = rf"\s+(?=[%$€£]|{_WORD})"
ASKING = "|".join(w.replace(" ", r"\s+") for words in HOW_MANY.values() for w in words)
_ASKED = rf"(?<![{TOKEN}])(?iu:{ASKING})(?=\s+{_WORD})"
#: The readings: whether names and units are merged.
READINGS = (False, True)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[^{TOKEN}]+"), "")


def _numbered(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,](?<=\d[.,])(?=\d)", POINT)
    return F.regexp_replace(t, rf"(\d[\d{POINT}]*)", f" {NUMBER}$1 ")


def _tokens(text: Column, merged: bool) -> Column:
    """Template tokens of a reading; a slot's token goes on with its lower-case value, a number's with its unit."""
    t = _numbered(text)
    if not merged:
        return _split(F.regexp_replace(t, f"({_NAMES})", f"{NAME}$1"))
    t = F.regexp_replace(F.regexp_replace(t, _ASKED, f"$0 {NUMBER}"), rf"({NUMBER}[\d{POINT}]*){_UNIT}", f"$1{UNIT}")
    t = F.regexp_replace(t, _CAPITALS, f"{NAME}$0")
    t = F.regexp_replace(t, rf"({NAME}[{TOKEN}]*)\s(?={NAME})", f"$1{JOIN}")
    return F.transform(_split(t), lambda x: F.when(x.startswith(NAME), F.concat(F.lit(NAME), F.translate(x, JOIN + NAME, " "))).otherwise(x))


def _kinds(text: Column, merged: bool) -> Column:
    """The kinds of ``_tokens``, of which no value is kept, by fewer steps."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBERS, f" {NUMBER} ")
    if not merged:
        return _split(F.regexp_replace(t, f"{_NAMES}[{TOKEN}]*", NAME))
    t = F.regexp_replace(F.regexp_replace(t, _ASKED, f"$0 {NUMBER}"), rf"{NUMBER}{_UNIT}[{TOKEN}]+", NUMBER)
    return _split(F.regexp_replace(t, rf"{_CAPITALS}[{TOKEN}]*(?:\s\p{{Lu}}\p{{Ll}}[{TOKEN}]*)*+", NAME))


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(NUMBER, NAME)


def _kind(token: Column) -> Column:
    """A token without its value."""
    return F.when(_is_slot(token), F.substring(token, 1, 1)).otherwise(token)


def _bare(token: Column) -> Column:
    """A token without its unit."""
    return F.substring_index(token, UNIT, 1)


def _at(size: Column, length: int, stride: int) -> Column:
    last = size - length
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _near(kinds: Column, length: int, stride: int) -> Column:
    """Hashes of the windows that start at multiples of ``stride``."""
    return F.transform(_at(F.size(kinds), length, stride), lambda i: F.xxhash64(F.slice(kinds, i + 1, length)))


def _windows(tokens: Column, kinds: Column, length: int) -> Column:
    """(at, near, h) of every window; h tells a window of slots alone by its values, near by its kinds."""
    near = lambda i: F.xxhash64(F.slice(kinds, i + 1, length))
    own = lambda i: F.slice(tokens, i + 1, length)
    h = lambda i: F.when(F.forall(own(i), _is_slot), F.xxhash64(F.transform(own(i), _bare))).otherwise(near(i))
    return F.transform(_at(F.size(tokens), length, 1), lambda i: F.struct(i.alias("at"), near(i).alias("near"), h(i).alias("h")))


def _readings(df: DataFrame, text: str, tokens: str) -> DataFrame:
    """A row of ``df`` for each reading (column merged) of a text, which its tokens replace."""
    read = [F.struct(F.lit(merged).alias("merged"), _tokens(F.col(text), merged).alias("tokens")) for merged in READINGS]
    return df.withColumn("_r", F.explode(F.array(*read))).withColumn("merged", F.col("_r")["merged"]).withColumn(tokens, F.col("_r")["tokens"]).drop("_r", text)


def _items(bench: DataFrame, id_col: str, text_col: str, least_tokens: int) -> DataFrame:
    """(item_id, item, merged, item_tokens, need): item tells rows apart, need is the run that contaminates."""
    items = bench.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text")).withColumn("item", F.xxhash64("item_id", "_text")).dropDuplicates(["item"])
    items = _readings(items, "_text", "item_tokens").where(F.size("item_tokens") >= max(1, least_tokens))
    return items.withColumn("need", F.least(F.lit(RUN_TOKENS), F.size("item_tokens")))


def _windows_of(tokens: str, lengths: list[int]) -> Column:
    return F.explode(F.concat(*[_windows(F.col(tokens), F.col("_kinds"), n) for n in lengths]))


def stretches(pairs: DataFrame) -> DataFrame:
    """(…, run_tokens, n_slots, verbatim) of each stretch of good windows in (theirs, ours, need), tokens side by side.

    A window of ``need`` tokens is good if its tokens are of the same kinds
    and its slots verbatim, or consistent and no more than half of it.
    """
    both = F.zip_with("theirs", "ours", lambda a, b: F.struct(a.alias("a"), b.alias("b"), (_kind(a) == _kind(b)).alias("same"), _is_slot(a).alias("slot")))
    slots = lambda w: F.filter(w, lambda x: x["slot"])
    # Values side by side: a number by itself, a unit where both have one.
    part = lambda x, n: F.struct(*[F.get(F.split(x[side], UNIT), F.lit(n)).alias(side) for side in "ab"])
    unit = lambda x: F.when(F.contains(x["a"], F.lit(UNIT)) & F.contains(x["b"], F.lit(UNIT)), F.transform(F.array(part(x, 1)), lambda u: F.struct(F.concat(F.lit(UNIT), u["a"]).alias("a"), u["b"].alias("b"))))
    unit_or_none = lambda x: F.coalesce(unit(x), F.array().cast("array<struct<a:string,b:string>>"))
    values = lambda own: F.flatten(F.transform(own, lambda x: F.concat(F.array(part(x, 0)), unit_or_none(x))))
    verbatim = lambda pairs: F.forall(pairs, lambda x: F.substring_index(x["a"], UNIT, -1) == x["b"])

    def good(w: Column) -> Column:
        pairs = values(slots(w))
        consistent = F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["a"])))
        valued = F.filter(slots(w), lambda x: ~x["a"].startswith(NUMBER + UNIT))
        worded = 100 * F.size(valued) <= (100 - LEAST_WORD_PERCENT) * F.size(w)
        return F.forall(w, lambda x: x["same"]) & (verbatim(pairs) | (consistent & worded))

    df = pairs.withColumn("_both", both)
    at = F.when(F.size("_both") >= F.col("need"), F.sequence(F.lit(0), F.size("_both") - F.col("need"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_good", F.filter(at, lambda i: good(F.slice("_both", i + 1, F.col("need"))))).where(F.size("_good") > 0)
    edge = lambda step: F.filter("_good", lambda i: ~F.array_contains("_good", i + step))
    df = df.withColumn("_s", F.explode(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))))
    run = (F.col("_s")["last"] - F.col("_s")["first"] + F.col("need")).cast("int")
    df = df.withColumn("run_tokens", run).withColumn("_own", slots(F.slice("_both", F.col("_s")["first"] + 1, run)))
    return df.withColumn("n_slots", F.size("_own")).withColumn("verbatim", verbatim(values(F.col("_own")))).drop("_both", "_good", "_s", "_own")


def contamination(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_tokens: int = LEAST_TOKENS
) -> DataFrame:
    """(doc_id, item_id, run_tokens, n_slots, verbatim) for each document and item that it contains.

    run_tokens is the longest stretch all of whose windows count, in either
    reading, n_slots the slots in it, verbatim whether all their values are
    the item's own.

    Nulls: null texts contain nothing and are contained in nothing; a null
    doc_id or item_id is an id like any other. Repeated rows, items included,
    give one row per pair of ids. Items of fewer than ``least_tokens`` tokens
    are left out, items of fewer than thirteen are found whole. Empty tables
    give an empty result. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    items = written(_items(bench, item_id, item_text, least_tokens), "items")
    needs = [r["need"] for r in items.select("need").distinct().collect()]  # thirteen values at most
    lengths = sorted({min(WINDOW, n) for n in needs}) or [WINDOW]
    # A run of n tokens holds a window of WINDOW at a multiple of n - WINDOW + 1.
    strides = {n: min([x for x in needs if x >= WINDOW], default=RUN_TOKENS) - WINDOW + 1 if n == WINDOW else 1 for n in lengths}
    own = reduce(lambda c, n: c.when(F.least(F.lit(WINDOW), "need") == n, _windows(F.col("item_tokens"), F.col("_kinds"), n)), lengths, F.when(F.lit(False), F.array().cast("array<struct<at:int,near:bigint,h:bigint>>")))
    found = items.withColumn("_kinds", F.transform("item_tokens", _kind)).select("item", "merged", F.explode(own).alias("_w"))
    found = written(found.select("item", "merged", F.col("_w")["at"].alias("item_at"), F.col("_w")["near"].alias("near"), F.col("_w")["h"].alias("h")), "windows")
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    light = (items.agg(F.sum(F.size("item_tokens").cast("long"))).first()[0] or 0) <= MOST_BROADCAST_TOKENS
    near = lambda df, small: F.broadcast(df) if small else df

    kinds = docs.select("doc_id", *[_kinds(F.col("text"), merged).alias(f"_k{merged:d}") for merged in READINGS])
    every = F.concat(*[_near(F.col(f"_k{merged:d}"), n, strides[n]) for n in lengths for merged in READINGS])
    hits = kinds.select(F.col("doc_id").alias("_hit"), F.explode(every).alias("near")).join(near(found.select("near").distinct(), few), "near", "left_semi").select("_hit").distinct()
    # Equal rows have equal results: the text's hash tells rows of an id apart.
    some = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi").withColumn("row", F.xxhash64("doc_id", "text"))
    some = written(some, "suspects").dropDuplicates(["doc_id", "row"])
    read = written(_readings(some, "text", "tokens"), "readings")
    met = read.withColumn("_kinds", F.transform("tokens", _kind)).select("doc_id", "row", "merged", _windows_of("tokens", lengths).alias("_w"))
    met = met.select("doc_id", "row", "merged", F.col("_w")["at"].alias("at"), F.col("_w")["h"].alias("h")).join(near(found.drop("near"), few), ["merged", "h"])
    met = met.select("doc_id", "row", "merged", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # Texts come in again where they meet an item only.
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")) & (F.col("merged") == F.col("_merged"))
    pairs = met.join(near(items, light), ["item", "merged"]).join(read.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("merged").alias("_merged"), "tokens"), key)
    skip = F.greatest(F.lit(0), -F.col("shift"))
    n = F.greatest(F.lit(0), F.least(F.size("item_tokens") - skip, F.size("tokens") - F.col("shift") - skip))
    pairs = pairs.select("doc_id", "item_id", "need", F.slice("item_tokens", skip + 1, n).alias("theirs"), F.slice("tokens", F.col("shift") + skip + 1, n).alias("ours"))
    out = stretches(pairs).groupBy("doc_id", "item_id").agg(F.max(F.struct("run_tokens", "n_slots", "verbatim")).alias("_b"))
    return out.select("doc_id", "item_id", F.col("_b")["run_tokens"].alias("run_tokens"), F.col("_b")["n_slots"].alias("n_slots"), F.col("_b")["verbatim"].alias("verbatim"))


def without_contaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose id ``contamination`` returns; null ids compare as equal."""
    name = free_name(docs, "_bad")
    bad = contamination(docs, bench, doc_id, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
