r"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

All of it is built-in column functions. Words are lower-cased runs of letters and digits; an
item's set is its distinct five-word shingles (with fewer words, the whole sequence as one).

Items are partitioned by the size of their set (powers of two). A partition's bounds fix its
sketch: an item with n shingles of which a share of at least t must occur may miss at most
n - ceil(t n) of them, so its bottom-s MinHash sketch with s = floor((1-t) u) + h, u being the
partition's upper bound, has at least h members in every document that contains the item.
(s never exceeds n; h is 1 for tiny items, else HITS.) The search asks for h sketch members:
no contained item is missed, and a long document costs one probe a shingle, whatever its length.

Candidates are then verified: the document's shingles, as strings, are intersected with the
item's. Sketches are broadcast only when a count proves them small; otherwise the probe is
an ordinary shuffled join whose document side is made distinct first, and of which AQE splits the
partition of a shingle that very many documents hold. Candidates and results are some rows for each
leaking document: they are written as a file a core, not as one for each shuffle partition.

Edge cases: null or empty texts have no shingles and match nothing; short items (under five
words) match documents that consist of the same words, and documents under five words match
only such items; repeated items are reported under each item_id; repeated document rows give
one row; rows with a null doc_id are reported under it; ``clean`` judges each row by its own text, so
rows that share a doc_id, or have none, are told apart; very long texts are searched whole, one probe a
shingle; empty tables give no rows; other columns are ignored, whatever their names, and stay in ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import few_files, small, stored, text_or_empty, unused

WIDTH, CONTAINMENT, HITS = 5, 0.8, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(w: Column, width: int, make) -> Column:
    """make(list of word columns) for each window; the whole sequence if it is shorter; empty without words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + k) for k in range(width)]))
    whole = F.array(make([F.array_join(w, " ")]))
    return F.when(F.size(w) >= width, windows).when(F.size(w) > 0, whole).otherwise(F.slice(whole, 1, 0))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    return _shingles(w, width, lambda parts: F.xxhash64(*parts))


def shingle_strings(w: Column, width: int = WIDTH) -> Column:
    return _shingles(w, width, lambda parts: F.concat_ws(" ", *parts))


def item_sketches(items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, n (set size), size_class, need (hits to ask for), h (one sketch member a row)."""
    item_words = items.select("item_id", words(text_or_empty()).alias("w"))
    sets = item_words.select("item_id", F.array_distinct(shingle_hashes(F.col("w"), width)).alias("set")).filter(F.size("set") > 0)
    sized = sets.select("item_id", "set", F.size("set").alias("n"), F.ceil(F.log2(F.size("set").cast("double"))).cast("int").alias("size_class"))
    may_miss = F.floor((1 - containment) * F.pow(F.lit(2.0), "size_class") + 1e-9)
    own_miss = F.floor((1 - containment) * F.col("n") + 1e-9)
    length = F.least(F.col("n"), may_miss + HITS).cast("int")
    need = F.least(F.lit(HITS), length - own_miss).cast("int")
    # MinHash order: a hash of the hash, so that it does not follow the join key
    ranked = F.array_sort(F.transform("set", lambda h: F.struct(F.xxhash64(F.lit(77), h).alias("rank"), h.alias("h"))))
    return sized.select("item_id", "n", "size_class", need.alias("need"), F.explode(F.transform(F.slice(ranked, 1, length), lambda x: x["h"])).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared, containment; one row for each pair that reaches ``containment``."""
    sketches = stored(item_sketches(items, width, containment), "item-sketches")
    probe = small(sketches)
    doc_words = docs.select("doc_id", words(text_or_empty()).alias("w"))
    hashes = doc_words.select("doc_id", F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
    if probe is sketches:  # too many items to broadcast
        hashes = hashes.distinct()
    hits = hashes.join(probe, "h").groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("hits"))
    pairs = stored(few_files(hits.filter(F.col("hits") >= F.col("need")).select("doc_id", "item_id")), "benchmark-candidates")

    item_words = items.select("item_id", words(text_or_empty()).alias("w"))
    item_sets = item_words.select("item_id", F.array_distinct(shingle_strings(F.col("w"), width)).alias("item_set"))
    doc_texts = docs.select("doc_id", text_or_empty().alias("body"))
    # both joins broadcast the pairs if they are under Spark's size limit, and shuffle otherwise
    named = pairs.withColumnRenamed("doc_id", "_pair_id")
    checked = doc_texts.join(named, doc_texts["doc_id"].eqNullSafe(named["_pair_id"])).drop("_pair_id").join(item_sets, "item_id")
    # words are a column of their own: inside a window's expression they would be cut out anew for each window
    checked = checked.select("doc_id", "item_id", "item_set", words(F.col("body")).alias("w"))
    shared = F.size(F.array_intersect("item_set", shingle_strings(F.col("w"), width)))
    checked = checked.select("doc_id", "item_id", F.size("item_set").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    # the threshold is asked of the aggregate, for a filter on n_shared itself would be pushed below the words
    best = checked.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    best = few_files(best.filter(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9))
    return best.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that contain no item; all columns stay."""
    # the hash of doc_id and text stands for the row
    row = F.xxhash64("doc_id", text_or_empty())
    leaking = unused("_leaking", docs)
    leaks = contaminated(docs.select(row.alias("doc_id"), "text"), items, **how).select(F.col("doc_id").alias(leaking)).distinct()
    return docs.join(stored(few_files(leaks), "leaking-rows"), row == F.col(leaking), "left_anti")
