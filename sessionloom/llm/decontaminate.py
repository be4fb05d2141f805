"""Benchmark decontamination by winnowing: k-gram fingerprints, a join of fingerprints, and extension of the hits.

Only DataFrame functions run here. The minimum k-gram hash of the w k-grams in every run of k + w - 1 words is that run's
fingerprint. Two equal runs have equal fingerprints, so every shared run of WINDOW words is found; the words around a
joined fingerprint are then compared as text, which removes false hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import BROADCAST_ROWS, lower_ascii, narrow_side, written

#: What stands between words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
KGRAM = 5
#: Parts of each key where a table of keys is too large to be broadcast, so that a common phrase is no single task.
SALTS = 8


def words(text: Column) -> Column:
    """The lower-cased words; a null text has none."""
    cut = F.array_remove(F.split(lower_ascii(text), BETWEEN), "")
    return F.coalesce(cut, F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ahead(function, xs: Column, x: Column, i: Column, n: int) -> Column:
    return function(x, *(F.get(xs, i + j) for j in range(1, n))) if n > 1 else x


def fingerprints(word_array: Column, window: int, k: int = KGRAM, keep_all: bool = False) -> Column:
    """For each run of ``window`` words its fingerprint, at the run's index.

    Unless ``keep_all``, an entry is null if it repeats the entry before and its index is no multiple of the w; each
    entry that is left so stands for itself and the at most w - 1 nulls behind it.
    """
    k = min(k, window)
    w = window - k + 1
    hashes = F.transform(word_array, lambda x: F.xxhash64(x))
    grams = let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: _ahead(F.xxhash64, h, x, i, k)), 1, F.greatest(F.size(h) - (k - 1), F.lit(0))))
    least = let(grams, lambda g: F.slice(F.transform(g, lambda x, i: _ahead(F.least, g, x, i, w)), 1, F.greatest(F.size(g) - (w - 1), F.lit(0))))
    if keep_all or w == 1:
        return least
    return let(least, lambda m: F.transform(m, lambda x, i: F.when((i % w != 0) & (x == F.get(m, i - 1)), F.lit(None)).otherwise(x)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, fingerprint, window_text) for the runs of ``window`` words of each item, or all words of a shorter one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    prints = F.coalesce(*(F.when(size == n, fingerprints(F.col("w"), n, keep_all=True)) for n in range(1, window + 1)))
    runs = items.select("item_id", "w", size.alias("length"), F.posexplode(prints).alias("i", "fingerprint"))
    return runs.select("item_id", "length", "fingerprint", F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("window_text")).distinct()


def _matched(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``keys``, a written table: by broadcast if it has at most ``most`` rows, else salted by ``spread``."""
    if keys.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keys), on)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def _runs(word_array: Column, lengths: list[int]) -> Column:
    """An array of (length, at, fingerprint), for all lengths."""

    def of_length(n: int) -> Column:
        placed = F.transform(fingerprints(word_array, n), lambda x, i: F.when(x.isNotNull(), F.struct(F.lit(n).alias("length"), i.alias("at"), x.alias("fingerprint"))))
        return F.when(F.size(word_array) >= n, F.array_compact(placed))

    parts = [of_length(n) for n in lengths]
    return F.flatten(F.array_compact(F.array(*parts))) if len(parts) > 1 else parts[0]


def candidates(docs: DataFrame, windows: DataFrame, text_column: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, and near: (start, length, window_text) at joined fingerprints.

    Texts are read twice: once for the fingerprints, of which only places and hashes are joined, and once for the counts
    and the words around the places that joined.
    """
    key = [F.col("doc_id"), F.xxhash64(text_column).alias("text_hash")]
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # 1 to WINDOW
    # the words are a column of a step of their own, which the optimizer does not fold into their many uses
    worded = docs.select(*key, words(F.col(text_column)).alias("w"))
    if not lengths:
        return worded.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,length:int,window_text:string>>").alias("near"))
    keys = written(windows.select("length", "fingerprint").distinct(), "leak-fingerprints")
    # before the plain inline the optimizer would put a filter on the array, which computes it thrice
    placed = worded.select("doc_id", "text_hash", _runs(F.col("w"), lengths).alias("runs")).select("doc_id", "text_hash", F.inline_outer("runs")).where("fingerprint is not null")
    joined = _matched(placed, keys, ["length", "fingerprint"], F.xxhash64("doc_id", "text_hash", "at"), broadcast_rows)
    places = written(joined.select("doc_id", "text_hash", "length", "at").distinct(), "leak-places")
    of_text = places.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("length", "at")).alias("places"))
    if places.limit(broadcast_rows + 1).count() <= broadcast_rows:
        of_text = F.broadcast(of_text)
    with_places = worded.join(of_text, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")

    def around(place: Column) -> Column:
        length, at = place["length"], place["at"]
        w = length - F.least(length, F.lit(KGRAM)) + 1
        last = F.least(at + w - 1, F.size("w") - length)
        return F.transform(F.sequence(at, last), lambda p: F.struct(p.alias("start"), length.alias("length"), F.array_join(F.slice("w", p + 1, length), " ").alias("window_text")))

    near = F.array_distinct(F.flatten(F.transform("places", around)))
    return with_places.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), near.alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    A null or empty text has no words and no hits; very long texts are taken whole. Rows with the same doc_id and text are
    repeated rows: each is returned, with equal values. A null doc_id is kept. Items without words, or with a null item_id,
    hit nothing. Empty tables give no rows or no hits; columns but doc_id and text, whatever their names, are not looked at.
    Tables of at most ``broadcast_rows`` narrow rows are broadcast.
    """
    docs, key = docs.select("doc_id", "text"), ["doc_id", "text_hash"]
    windows = written(item_windows(benchmark.where("item_id is not null"), window), "leak-items")
    rows = written(candidates(docs, windows, broadcast_rows=broadcast_rows), "leak-candidates")
    texts = written(windows.select("window_text").distinct(), "leak-windows")
    near = rows.select(*key, F.inline("near")).distinct()
    spread = F.xxhash64(*key, "start")
    spans = written(_matched(near, texts, ["window_text"], spread, broadcast_rows // 5), "leak-hits")
    covered = spans.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    per_window = written(windows.select("window_text", "item_id").distinct(), "leak-owners")
    owners = _matched(spans.select(*key, "window_text").distinct(), per_window, ["window_text"], F.xxhash64(*key), broadcast_rows // 5)
    items = owners.select(*key, "item_id").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = covered.join(items, covered["doc_id"].eqNullSafe(items["doc_id"]) & (covered["text_hash"] == items["text_hash"])).select(covered["doc_id"].alias("_doc"), covered["text_hash"].alias("_hash"), "n_hit", "items")
    out = rows.drop("near").join(found, rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["text_hash"] == found["_hash"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of a benchmark item occurs."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    bad = narrow_side(written(bad, "leak-bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")
