"""Operator 6: benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are canonicalised alike: numbers, names
and units become typed placeholders. Windows of canonical words are hash-joined
with those of the benchmark, so a question whose parameters were changed still
matches; then the slots' values are compared: along one alignment (document
place less item place) every value of the item must stand for one value of the
document, else windows that hold such a slot are no copy. Beside them, windows
of the lower-cased words as they stand are joined alike; these are copies
whatever their words. A document is contaminated by an item when its windows
cover half of the item's words, or `run` of them.

Each word is hashed once; windows are hashes of slices of word hashes, and are only built where a bit table of the
benchmark says that a window may begin with this pair of words (it only rules out; the join decides). Texts of
documents with a shared canonical window are read again, by a semi-join, to compare slots.

A text of any length is one row: its words, their hashes and the windows that may match are arrays of that row.
Null text: as empty; never contaminated. Null item text or one without words:
matches nothing; one of too few literal words: only as it stands. Repeated rows (same id and text): each has its
own row with the same verdict. Empty documents: an empty result; empty
benchmark: no document is contaminated. Ties: item ids ascend in the lists. Only
doc_id and text, and item_id and text, are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import packed, texts
from lapse.session import materialize

#: Words in a window; a shorter item is one window of its own.
WINDOW = 8
#: Least share of a canonical window's words that are literal, i.e. no placeholders.
LITERAL = 0.6
#: Words that consistent windows must cover: this share of the item, or so many.
SHARE, RUN = 0.5, 13
#: Most benchmark windows that are broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Most keys of contaminated documents that are broadcast.
BROADCAST_KEYS = 2_000_000
#: Bits of the table of pairs of words that begin windows of the benchmark, in words of 64.
TABLE_WORDS = 1 << 14

#: Separators: all but letters and digits; a point or comma between digits belongs to the number.
BETWEEN = r"(?:[^\p{L}\p{N}.,\x02]|[.,](?:(?![0-9])|(?<![0-9][.,])))+"
#: Where a sentence begins with a capital, a mark keeps that word from counting as a name.
SENTENCE = r"(^|[.!?:;\n][\s\"'(\[]{0,4})(?=\p{Lu})"
# Words that stand for units and numbers, in English, German, French and Spanish.
UNITS = ("km m cm mm kg g mg lb lbs miles mile hours hour minutes minute seconds days day weeks years percent dollars euros cents liters litres "
         "meters metres feet inches "
         "stunden stunde minuten sekunden tage tag wochen jahre prozent dollar euro meter liter gramm kilo kilometer meilen "
         "heures heure secondes jours jour semaines ans années mètres grammes kilomètres pourcent "
         "horas hora minutos segundos días día semanas años metros litros gramos kilómetros dólares").split()
NUMBERS = ("one two three four five six seven eight nine ten eleven twelve twenty thirty hundred thousand "
           "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend "
           "deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille "
           "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cien mil").split()
NUMBER, NAME, UNIT = "\x02n", "\x02p", "\x02u"


def raw_words(text: Column) -> Column:
    """Words as they stand, those that begin a sentence marked."""
    return F.array_remove(F.split(F.regexp_replace(text, SENTENCE, "$1\x02"), BETWEEN), "")


def canonical(word: Column) -> Column:
    """Placeholder of a number, name or unit; any other word in lower case, unmarked."""
    return _canonical(word, F.lower(word))


def _canonical(word: Column, low: Column) -> Column:
    digit = (word >= "0") & (word < ":")  # begins with one
    # Most words are neither: one lookup tells.
    listed = F.when(word.isin(NUMBERS), NUMBER).otherwise(UNIT)
    return (F.when(low == word, F.when(digit, NUMBER).when(word.isin(NUMBERS + UNITS), listed).otherwise(word))
            .when(word.startswith("\x02"), F.substring(low, 2, 1 << 30))
            .when(word.rlike(r"^\p{Lu}\p{Ll}"), NAME).otherwise(low))


def as_stands(word: Column) -> Column:
    """The word in lower case, unmarked."""
    return F.lower(F.translate(word, "\x02", ""))


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def hashed(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, cs, vs): hashes of the canonical words of `ws`, and of the words as they stand."""
    lower = words.select(*key, "ws", F.transform("ws", lambda w: F.lower(w)).alias("ls"))  # once a word, for both
    bare = lambda w, low: F.when(w.contains("\x02"), as_stands(w)).otherwise(low)  # noqa: E731  marked words are few
    return lower.select(*key, F.zip_with("ws", "ls", lambda w, low: F.xxhash64(_canonical(w, low))).alias("cs"),
                        F.zip_with("ws", "ls", lambda w, low: F.xxhash64(F.lit(1), bare(w, low))).alias("vs"))


def windows(words: DataFrame, lengths: list[int], key: list[str], begins: list[int]) -> DataFrame:
    """(key, place, length, hash, as_is) of windows of word hashes `cs` and `vs`, for each length, that may begin a window
    of the benchmark by the bit table `begins`."""
    table = F.split(F.lit(",".join(map(str, begins))), ",").cast("array<bigint>")  # folded to a constant by the optimizer
    parts, starts = [], []
    for form in ("cs", "vs"):
        for wide in sorted({min(n, 2) for n in lengths}):
            name = f"{form}{wide}"
            starts.append(_starts(form, wide, table).alias(name))
            parts += [_windows_of(name, n, form) for n in lengths if min(n, 2) == wide]
    found = F.concat(*parts) if parts else F.array().cast(_WINDOW)
    placed = words.select(*key, "cs", "vs", *starts)
    return placed.select(*key, F.explode(found).alias("w")).select(*key, "w.place", "w.length", "w.hash", "w.as_is")


_WINDOW = "array<struct<place:int,length:int,hash:bigint,as_is:boolean>>"


def _starts(form: str, n: int, table: Column) -> Column:
    """Places, from 1, of the word hashes that may begin a window of `n` words; the last word has no second one."""
    mixed = F.col(form) if n == 1 else F.zip_with(form, F.slice(form, 2, 1 << 30), _mixed)
    return F.array_compact(F.transform(mixed, lambda x, i: F.when(_may_begin(table, x), i + 1)))


def _windows_of(starts: str, n: int, form: str) -> Column:
    return F.transform(F.filter(starts, lambda i: i <= F.size(form) - n + 1), lambda i: F.struct(
        i.alias("place"), F.lit(n).alias("length"), F.xxhash64(F.slice(form, i, n)).alias("hash"), F.lit(form == "vs").alias("as_is")))


def _mixed(first: Column, second: Column) -> Column:
    """One hash of a pair of word hashes; cheap, as these are mixed already."""
    return F.shiftleft(first, 1).bitwiseXOR(second)


def _bit(mixed: Column) -> tuple[Column, Column]:
    """Word of the bit table, by the highest bits, and bit in it, by the lowest."""
    return F.shiftrightunsigned(mixed, 65 - TABLE_WORDS.bit_length()).cast("int"), mixed.bitwiseAND(F.lit(63)).cast("int")


def _may_begin(table: Column, mixed: Column) -> Column:
    at, bit = _bit(mixed)
    return F.call_function("shiftright", F.get(table, at), bit).bitwiseAND(F.lit(1)) != 0


def bit_table(items: DataFrame) -> list[int]:
    """TABLE_WORDS words of 64 bits: which pairs of word hashes (or single ones) begin a window of `items`."""
    first, second = (F.get("begin", F.lit(k)) for k in (0, 1))
    at, bit = _bit(F.when(F.size("begin") == 1, first).otherwise(_mixed(first, second)))
    bits = items.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    table = [0] * TABLE_WORDS
    for r in bits.groupBy("at").agg(F.bit_or("b").alias("b")).collect():  # TABLE_WORDS rows at most
        table[r["at"]] = r["b"]
    return table


def item_windows(benchmark: DataFrame, window: int = WINDOW, literal: float = LITERAL) -> DataFrame:
    """(item_id, n_words, place, length, hash, begin, ws): windows of the benchmark with enough literal words; an item
    shorter than a window is one. `ws` are the item's words as they stand."""
    cut = _item_cuts(benchmark, window, canonical)
    literals = F.size(F.filter("cut", lambda w: ~w.startswith("\x02")))
    return cut.where(literals >= literal * F.col("length")).select(
        "item_id", "n_words", "place", "length", *_hashes(lambda w: F.xxhash64(w)), "ws")


def verbatim_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of `item_windows` for all windows of the benchmark's words as they stand."""
    return _item_cuts(benchmark, window, as_stands).select(
        "item_id", "n_words", "place", "length", *_hashes(lambda w: F.xxhash64(F.lit(1), w)), "ws")


def _hashes(of: Callable[[Column], Column]) -> tuple[Column, Column]:
    words = F.transform("cut", of)
    return F.xxhash64(words).alias("hash"), F.slice(words, 1, 2).alias("begin")


def _item_cuts(benchmark: DataFrame, window: int, form: Callable[[Column], Column]) -> DataFrame:
    items = benchmark.select(benchmark["item_id"], raw_words(F.coalesce(benchmark["text"], F.lit(""))).alias("ws")).distinct()
    items = items.withColumn("fs", F.transform("ws", form)).withColumn("n_words", F.size("fs"))
    length = F.least(F.col("n_words"), F.lit(window))
    placed = items.where("n_words > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - length + 1)).alias("place"), length.alias("length"))
    return placed.withColumn("cut", F.slice("fs", F.col("place"), F.col("length")))


def matches(docs: DataFrame, items: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(key, item_id, n_words, doc_place, item_place, length, as_is) of windows that a document shares with an item."""
    words = texts(docs).select(_key(F.col("doc_id"), F.col("text")).alias("key"), raw_words(F.col("text")).alias("ws"))
    own = windows(hashed(words, ["key"]), lengths, ["key"], bit_table(items))
    theirs = items.select("hash", "length", "item_id", "n_words", F.col("place").alias("item_place"))
    # A hot window (a passage in many documents) sits on the streamed side; beyond the bound the join shuffles and
    # adaptive execution splits its partition.
    joined = own.join(F.broadcast(theirs) if small else theirs, ["hash", "length"])
    return joined.select("key", "item_id", "n_words", F.col("place").alias("doc_place"), "item_place", "length", "as_is")


def item_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(key, item_id, n_windows, coverage, hit) of documents and items with a shared window; key: xxhash64 of id and text."""
    items = materialize(item_windows(benchmark, window).union(verbatim_windows(benchmark, window)), "op6-items")
    of = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `window` rows at most
    small = sum(of.values()) <= BROADCAST_WINDOWS
    # Matched windows are few and written once: whole texts aren't canonicalised anew for each use.
    found = materialize(matches(docs, items, sorted(of), small), "op6-matches")
    return covered(found, slots_agree(docs, items, found), share, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, **rules: float) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, n_windows, coverage): one row for each row of `docs`."""
    verdict = item_hits(docs, benchmark, **rules).groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("item_id")))).alias("item_ids"),
        F.sum("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"))
    own = texts(docs).select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("key"))
    ids = F.coalesce("item_ids", F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>"))
    return own.join(verdict, "key", "left").select(
        "doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, **rules: float) -> DataFrame:
    """`docs` without the contaminated ones. Few keys are broadcast, more are shuffled."""
    gone = materialize(item_hits(docs, benchmark, **rules).where("hit").select(F.col("key").alias("key_")).distinct(), "op6-hits")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    own = packed(docs).withColumn("key", _key(F.col("whole.doc_id"), F.coalesce("whole.text", F.lit(""))))
    return own.join(small, F.col("key") == F.col("key_"), "left_anti").select("whole.*")


def slots_agree(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(key, item_id, shift, bad): places of the item whose slots disagree along an alignment, i.e. one value of the item
    meets two of the document.

    Only documents and items with a shared canonical window are read again."""
    aligned = found.where("NOT as_is").withColumn("shift", F.col("doc_place") - F.col("item_place"))
    keys = materialize(aligned.select(F.col("key").alias("key_")).distinct(), "op6-keys")
    # Few keys are broadcast, so that other texts stay where they are; more are shuffled.
    small = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    own = texts(docs).select(_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    words = own.join(small, F.col("key") == F.col("key_"), "left_semi").dropDuplicates(["key"]).select("key", raw_words(F.col("text")).alias("dw"))
    bench = items.select("item_id", F.col("ws").alias("iw")).distinct()
    runs = aligned.groupBy("key", "item_id", "shift").agg(F.collect_set(F.struct("item_place", "length")).alias("at"))
    placed = runs.join(words, "key").join(bench, "item_id")
    # Places of the item whose canonical word stands at the aligned place of the document, in unbroken stretches that
    # hold a shared window; a window of few literal words is no match by itself, but its slots count.
    theirs, ours = (lambda p: F.get("iw", p - 1)), (lambda p: F.get("dw", p + F.col("shift") - 1))
    same = lambda p: F.coalesce((p + F.col("shift") >= 1) & (canonical(theirs(p)) == canonical(ours(p))), F.lit(False))
    stretched = (
        placed.withColumn("windowed", F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["item_place"], x["item_place"] + x["length"] - 1)))))
        .withColumn("places", F.filter(F.sequence(F.lit(1), F.size("iw")), same))
        .withColumn("stretches", F.transform("places", lambda p, i: F.struct(p.alias("p"), (p - i).alias("of"))))
        .withColumn("held", F.array_distinct(F.transform(F.filter("stretches", lambda x: F.array_contains("windowed", x["p"])), lambda x: x["of"])))
        .withColumn("used", F.transform(F.filter("stretches", lambda x: F.array_contains("held", x["of"])), lambda x: x["p"])))
    pairs = stretched.select("key", "item_id", "shift", F.transform("used", lambda p: F.struct(
        p.alias("p"), theirs(p).alias("theirs"), ours(p).alias("ours"))).alias("pairs"))
    slots = pairs.select("key", "item_id", "shift", F.explode(F.filter("pairs", lambda x: canonical(x["theirs"]).startswith("\x02"))).alias("x"))
    values = slots.groupBy("key", "item_id", "shift", "x.theirs").agg(
        F.min("x.ours").alias("a"), F.max("x.ours").alias("b"), F.collect_list("x.p").alias("bad"))
    return values.where("a <> b").groupBy("key", "item_id", "shift").agg(F.flatten(F.collect_list("bad")).alias("bad"))


def covered(found: DataFrame, disagree: DataFrame, share: float, run: int) -> DataFrame:
    """(key, item_id, n_windows, coverage, hit): places of an item that consistent windows, or such as they stand, cover."""
    placed = found.withColumn("shift", F.col("doc_place") - F.col("item_place")).join(disagree, ["key", "item_id", "shift"], "left")
    holds = F.coalesce(F.exists("bad", lambda p: p.between(F.col("item_place"), F.col("item_place") + F.col("length") - 1)), F.lit(False))
    # A window found both ways, or in repeated rows, is one.
    aligned = placed.where(F.col("as_is") | ~holds).select("key", "item_id", "n_words", "doc_place", "item_place", "length").distinct()
    # A document can hold an item's window many times; its places in the item are counted once.
    starts = aligned.groupBy("key", "item_id", "n_words", "item_place", "length").agg(F.count(F.lit(1)).alias("n"))
    own = starts.groupBy("key", "item_id", "n_words").agg(F.sum("n").alias("n_windows"), F.collect_list(F.struct("item_place", "length")).alias("at"))
    places = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["item_place"], x["item_place"] + x["length"] - 1)))))
    return own.withColumn("n", places).select(
        "key", "item_id", "n_windows", (F.col("n") / F.col("n_words")).alias("coverage"),
        ((F.col("n") >= share * F.col("n_words")) | (F.col("n") >= run)).alias("hit"))
