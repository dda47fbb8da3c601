"""Benchmark decontamination by template canonicalisation [native].

Texts are reduced to templates: numbers, names (capitalised words inside a sentence) and units become typed placeholders,
case and punctuation go.  A capitalised word that starts a sentence, a line or a quotation may be a name or not: it counts
as its word and as a name, so its windows have a hash for either reading (only its letters: "Anna's" there is a name and
an "s", "Anne-Marie" two names).  Windows of five template words of the documents are hash-joined to those of the benchmark items.
A document that holds at least 80 % of an item's distinct windows is a candidate; its slots are then checked, alignment by
alignment: a slot (a placeholder of the item) is consistent if the document has the item's own value there, or if all
slots of that value have one other value.  Possible names are slots only where the item or the document has a name for sure
or the words differ.  An alignment that holds 80 % of the windows and 80 % consistent slots makes the
document contaminated, whatever else it holds.  That catches items whose numbers or names were replaced while the template
was kept, and items held more than once.

Alignments of a (document, item) are its diagonals (document position minus item position), bands of diagonals as wide as
the item (two grids, half a width apart: copies with words put in or left out) and the whole document (scattered parts).
Where several diagonals of an alignment cover a slot, the one of most windows gives its value, then the smallest.

Two passes: the first carries hashes only and finds the (document, item) candidates; the second re-reads the candidates'
texts for positions and slot values.  The benchmark's windows are broadcast while there are at most ``max_broadcast`` of them (counted
first); a larger benchmark is joined by shuffle.  Window hashes that the join keeps are pre-aggregated per document.

Defined results: an item of fewer words than a window is looked for by windows of its own length, and if it holds no
ordinary word, only with its own values; NULL or empty texts hold and are held by nothing; an empty benchmark flags nothing; a document matching several items lists them all in order; repeated rows are judged each; extra columns
pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

WINDOW = 5
SIMILARITY = 0.8
CONSISTENT = 0.8
MAX_BROADCAST = 1_000_000      # benchmark windows (16 bytes each) up to which their table is broadcast
# Units that become a placeholder after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg lb oz ml l s min h hr hrs hours minutes seconds days weeks years "
         "usd eur gbp dollars euros cents percent % kb mb gb tb hz khz mhz ghz v w kw j kj c f k")
NUMBER = r"\d+(?:[.,:/]\d+)*"
MARKS = "\x01\x02\x03\x04\x05"   # number, unit, name, end of a value, possible name; in texts they count as white space
NAME = r"(?=\p{Lu}\p{Ll})(?<=[^.!?:;\x20\x09-\x0D][\x20\x09-\x0D])(\p{Lu}\p{Ll}[\p{L}'-]*)"
INITIAL = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{Nd}\x01\x03\x04])(?<!\p{L}['-])(\p{Lu}\p{Ll}\p{L}*)"


def _unmarked(text: Column) -> Column:
    """The text without characters that serve as marks (few texts hold one, and translate is slow)."""
    return F.when(text.rlike(f"[{MARKS}]"), F.translate(text, MARKS, " " * len(MARKS))).otherwise(text)


def template_text(text: Column) -> Column:
    """Whole-text canonicalisation: placeholders <N> <U> <P>, possible names marked, lower case, punctuation dropped; words
    by one space."""
    units = "|".join(u for u in UNITS.split() if u.isalpha())
    plain = _unmarked(text)
    out = F.regexp_replace(plain, rf"\b{NUMBER}([\x20\x09-\x0D]*(?:%|(?:{units})\b))", "\x01\x20\x02\x20")
    out = F.when(text.rlike("[0-9]"), F.regexp_replace(out, rf"\b{NUMBER}\b", "\x01")).otherwise(plain)
    out = F.regexp_replace(F.regexp_replace(out, NAME, "\x03"), INITIAL, "\x05$1")
    return F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{Nd}\x01\x02\x03\x05]+", " "))


def word_code(word: Column) -> Column:
    """Hash of a template word without its mark; window hashes are made from these, so that words are read once."""
    return F.xxhash64(F.when(word.startswith("\x05"), F.substring(word, 2, 2 ** 31 - 1)).otherwise(word))


def _masks(mask: Column, n: int) -> Column:
    """The subsets of a bit mask, the empty one first."""
    grown = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array(F.lit(0)), lambda acc, k: F.when(
        F.expr("0") == F.pmod(F.floor(mask / F.pow(F.lit(2), k)), F.lit(2)), acc).otherwise(
        F.concat(acc, F.transform(acc, lambda a: a + F.pow(F.lit(2), k).cast("int")))))
    return F.when(mask == 0, F.array(F.lit(0))).when(mask.bitwiseAND(mask - 1) == 0, F.array(F.lit(0), mask)).otherwise(grown)


def _keys_at(plain: Column, unsure: Column, i: Column, n: int) -> Column:
    """Hashes of the n word codes from i: as they are, and with each choice of the possible names among them as names."""
    mask = sum((F.when(F.get(unsure, i + k), 1 << k).otherwise(0) for k in range(1, n)), F.when(F.get(unsure, i), 1).otherwise(0))
    return F.flatten(F.transform(F.array(mask), lambda m: F.transform(_masks(m, n), lambda chosen: F.xxhash64(
        *[F.when(chosen.bitwiseAND(1 << k) != 0, F.xxhash64(F.lit("\x03"))).otherwise(F.get(plain, i + k))
          for k in range(n)]))))


def _starts(words: Column, n: int) -> Column:
    """Positions of the n-word windows."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _keys(n: int) -> Column:
    """The plain hashes of all windows, and all hashes of the windows that hold possible names (few, and slow to make)."""
    plain, unsure = F.col("plain"), F.col("unsure")
    each = F.transform(_starts(plain, n), lambda i: F.xxhash64(*[F.get(plain, i + k) for k in range(n)]))
    at = F.filter(F.transform(unsure, lambda u, i: F.when(u, i)), lambda i: i.isNotNull())
    starts = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - n + 1, F.lit(0)), p)))
    starts = F.filter(F.array_distinct(starts), lambda i: i <= F.size(plain) - n)
    return F.concat(F.array(each), F.transform(starts, lambda i: _keys_at(plain, unsure, i, n)))


def _templates(rows: DataFrame) -> DataFrame:
    """The columns of rows, plain (codes of the template's words) and unsure (which of them are possible names)."""
    words = F.when(F.col("template") != "", F.split("template", " ")).otherwise(F.array().cast("array<string>"))
    named = F.transform("words", lambda w: w.startswith("\x05"))
    return (rows.withColumn("template", template_text(F.col("text"))).withColumn("words", words).drop("template")
            .withColumn("plain", F.transform("words", word_code)).withColumn("unsure", named))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 similarity: float = SIMILARITY, consistent: float = CONSISTENT,
                 max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per (document row, item) found: doc_id, text_key, item_id, share, n_slots, n_consistent."""
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text).alias("text")) \
        .withColumn("item_key", F.xxhash64("text"))
    cut = staged(_item_windows(_templates(items), window), "bench-windows")
    lengths = sorted(r[0] for r in cut.select("n_window").distinct().collect())        # window, and those of short items
    counts = cut.groupBy("item_id", "item_key").agg(F.countDistinct("w").alias("n_keys"))
    item_keys = cut.alias("c").join(F.broadcast(counts).alias("n") if cut.count() <= max_broadcast else counts.alias("n"),
                                    F.col("c.item_id").eqNullSafe(F.col("n.item_id")) & (F.col("c.item_key") == F.col("n.item_key"))) \
        .select("c.item_id", "c.item_key", "n_keys", "w", "key").distinct()
    keys = item_keys.groupBy("key").agg(F.collect_set(F.struct("item_id", "item_key", "n_keys", "w")).alias("items"))
    small = item_keys.count() <= max_broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")) \
        .withColumn("text_key", F.xxhash64("text"))
    # outer: for an inner explode the optimiser would test the array's size below, and compute the words anew per window
    doc_keys = F.flatten(F.concat(*[_keys(n) for n in lengths or [window]]))
    windows = _templates(rows).select("doc_id", "text_key", F.explode_outer(doc_keys).alias("key"))
    hits = windows.join(F.broadcast(keys) if small else keys, "key")
    found = (hits.select("doc_id", "text_key", F.explode("items").alias("item")).select("doc_id", "text_key", "item.*")
             .distinct().groupBy("doc_id", "text_key", "item_id", "item_key", "n_keys")
             .agg(F.count(F.lit(1)).alias("n_hit"))
             .filter(F.col("n_hit") >= similarity * F.col("n_keys"))
             .select("doc_id", "text_key", "item_id", "item_key", "n_keys", (F.col("n_hit") / F.col("n_keys")).alias("share")))
    found = staged(found, "bench-found")
    return _with_slots(found, rows, items, window, lengths, similarity, consistent)


def _valued(text: Column) -> Column:
    """The template's words; a placeholder is followed by its value and an end mark."""
    units = "|".join(u for u in UNITS.split() if u.isalpha())
    out = F.regexp_replace(_unmarked(text),
                           rf"\b({NUMBER})[\x20\x09-\x0D]*(%|(?:{units})\b)", "\x01$1\x04\x20\x02$2\x04\x20")
    out = F.regexp_replace(out, rf"\b({NUMBER})\b(?![\d.,:/]*\x04)", "\x01$1\x04")
    out = F.regexp_replace(F.regexp_replace(out, NAME, "\x03$1\x04"), INITIAL, "\x05$1\x04")
    letters = r"[\p{L}\p{Nd}]"
    return F.regexp_extract_all(F.lower(out), F.lit(
        rf"{letters}*+(?:[\x01-\x03\x05][^\x04]*+\x04{letters}*+)++|{letters}++"), F.lit(0))


def _valued_templates(rows: DataFrame) -> DataFrame:
    """As _templates, with words that hold their values."""
    plain = F.transform("words", lambda w: F.xxhash64(F.regexp_replace(w, r"([\x01-\x03])[^\x04]*\x04|[\x04\x05]", "$1")))
    return rows.withColumn("words", _valued(F.col("text"))).withColumn("plain", plain) \
        .withColumn("unsure", F.transform("words", lambda w: w.startswith("\x05")))


def _cut(rows: DataFrame, ident: list[str], lengths: list[int], least: int = 0) -> DataFrame:
    """ident, n_words, n_window, and of each window its position, words, plain hash (w) and each of its hashes (key);
    windows shorter than ``least`` only where the text is no longer."""
    def windows(n: int) -> Column:
        at = _starts(F.col("plain"), n)
        at = at if n >= least else F.when(F.size("plain") == n, at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            F.lit(n).alias("n_window"), i.alias("at"), F.slice("words", i + 1, n).alias("words"),
            _keys_at(F.col("plain"), F.col("unsure"), i, n).alias("keys")))
    # outer, for the same reason as above
    cut = rows.select(*ident, F.size("plain").alias("n_words"), F.explode_outer(F.concat(*[windows(n) for n in lengths])).alias("x"))
    cut = cut.select(*ident, "n_words", "x.*")
    return cut.select(*ident, "n_words", "n_window", "at", "words", F.col("keys")[0].alias("w"),
                      F.explode_outer("keys").alias("key")).filter("key is not null")


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    return _cut(items, ["item_id", "item_key"], list(range(1, n + 1)), n)


def _slots(item_at: Column, item_words: Column, doc_words: Column) -> Column:
    """Item position, item value, document value and certainty of each slot of a pair of equal windows."""
    def slot(was: Column, k: Column) -> Column:
        name, value = was.rlike("[\x03\x05]"), F.get(doc_words, k)
        return F.struct((item_at + k).alias("at"),
                        F.when(name, F.concat(F.lit("\x03"), F.regexp_replace(was, "[\x03-\x05]", ""))).otherwise(was).alias("was"),
                        F.when(name, F.concat(F.lit("\x03"), F.regexp_replace(value, "[\x03-\x05]", ""))).otherwise(value).alias("value"),
                        (was.rlike("[\x01-\x03]") | (name & value.contains("\x03"))).alias("sure"), (name | was.rlike("[\x01\x02]")).alias("slot"))
    return F.filter(F.transform(item_words, slot), lambda x: x["slot"])


def _with_slots(found: DataFrame, rows: DataFrame, items: DataFrame, n: int, lengths: list[int],
                similarity: float, consistent: float) -> DataFrame:
    """The candidates of which an alignment passes, with the slots of the best one."""
    same = F.col("f.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("f.text_key") == F.col("d.text_key"))
    texts = rows.alias("d").join(found.select("doc_id", "text_key").distinct().alias("f"), same) \
        .select("d.doc_id", "d.text_key", "d.text").distinct()
    in_docs = _cut(_valued_templates(texts), ["doc_id", "text_key"], lengths or [n]).alias("d")
    in_items = _valued_templates(items.select("item_id", "item_key", "text").distinct())
    worded = F.exists("words", lambda w: ~w.rlike("[\x01-\x05]"))
    in_items = _cut(in_items.withColumn("worded", worded), ["item_id", "item_key", "worded"], list(range(1, n + 1)), n).alias("i")
    pair = ["doc_id", "text_key", "item_id", "item_key", "n_keys"]
    diagonals = staged(
        found.alias("f").join(in_items, F.col("f.item_id").eqNullSafe(F.col("i.item_id"))
                              & (F.col("f.item_key") == F.col("i.item_key")))
        .join(in_docs, same & (F.col("d.key") == F.col("i.key")))
        .select(*[f"f.{c}" for c in pair], "i.n_words", (F.col("i.worded") | (F.col("i.n_window") >= n)).alias("free"),
                "i.at", "i.w", (F.col("d.at") - F.col("i.at")).alias("diagonal"),
                _slots(F.col("i.at"), F.col("i.words"), F.col("d.words")).alias("slots"))
        .groupBy(*pair, "n_words", "free", "diagonal").agg(
            F.countDistinct("at").alias("hits"), F.collect_set("w").alias("keys"),
            F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")), "bench-diagonals")

    def band(kind: int, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    shifted = F.col("diagonal") + F.floor(F.col("n_words") / 2)
    alignments = diagonals.withColumn("alignment", F.explode(F.array(
        band(0, F.col("diagonal")), band(1, F.floor(F.col("diagonal") / F.col("n_words"))),
        band(2, F.floor(shifted / F.col("n_words"))), band(3, F.lit(0)))))
    one = [*pair, "alignment"]
    held = alignments.select(*one, F.explode("keys").alias("key")).groupBy(*one) \
        .agg(F.countDistinct("key").alias("n_held")).filter(F.col("n_held") >= similarity * F.col("n_keys"))
    slots = alignments.select(*one, "free", "hits", "diagonal", F.explode("slots").alias("s")) \
        .groupBy(*one, "free", "s.at", "s.was") \
        .agg(F.max_by("s.value", F.struct("hits", -F.col("diagonal"))).alias("value"),
             F.max_by("s.sure", F.struct("hits", -F.col("diagonal"))).alias("sure"))
    own = F.count(F.when(F.col("value") == F.col("was"), 1))
    per_value = slots.groupBy(*one, "free", "was").agg(
        F.count(F.lit(1)).alias("n"), own.alias("n_own"), F.countDistinct("value").alias("values"), F.max("sure").alias("sure")) \
        .filter(F.col("sure") | (F.col("n_own") < F.col("n")))
    judged = per_value.groupBy(*one).agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when(F.col("free") & (F.col("values") == 1), F.col("n")).otherwise(F.col("n_own"))).alias("n_consistent"))
    equal = [F.col(f"h.{c}").eqNullSafe(F.col(f"j.{c}")) for c in one]
    passed = held.alias("h").join(judged.alias("j"), equal, "left").select(
        *[f"h.{c}" for c in pair], F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce("n_consistent", F.lit(0)).alias("n_consistent")).filter(F.col("n_consistent") >= consistent * F.col("n_slots"))
    best = passed.groupBy(*pair).agg(F.max(F.struct("n_consistent", "n_slots")).alias("best"))
    equal = [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in pair]
    return found.alias("f").join(best.alias("b"), equal).select(
        "f.doc_id", "f.text_key", "f.item_id", "f.share", F.col("b.best.n_slots").alias("n_slots"),
        F.col("b.best.n_consistent").alias("n_consistent"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """One row per input row: doc_id, n_items, item_ids (ascending), max_share, contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key")).alias("d")
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    per = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                                                  F.max("share").alias("max_share")).alias("f")
    out = rows.join(per, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")),
                    "left")
    item_type = found.schema["item_id"].dataType.simpleString()
    ids = F.coalesce("item_ids", F.array().cast(f"array<{item_type}>"))
    return out.select("d.doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                      F.coalesce("max_share", F.lit(0.0)).alias("max_share"), (F.size(ids) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The rows of docs, all columns, without contaminated documents."""
    found = contaminated(docs, benchmark, id_col, text_col, **options).select(
        F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_found_id"))
                     & (F.xxhash64(text_of(text_col)) == F.col("_found_key")), "left_anti")
