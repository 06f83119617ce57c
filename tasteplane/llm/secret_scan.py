r"""Secret scans: pattern candidates, separated by how many owners hold the same value.

All of it is built-in column functions. Base kinds, leftmost and non-overlapping within a
kind: assign, access and hex. Further kinds that the method adds: vendor keys, signed web
tokens and private keys. Every candidate value is hashed and the corpus is asked in how many
repositories (sources) and owners (the part of a source before the first slash) it occurs:
a value that at least ``shared_owners`` owners hold is a copied example, one whose owners
are fewer looks live. Added kinds give spans only where the value looks live; base spans
always stay.

A private key's value is its body (without line breaks, quotes and the like, so the same key
wrapped in another way is the same value). A header that no body follows is the same text everywhere:
it is a span, and is never judged by its owners.

``hex`` is scanned with the length in the pattern: its runs are maximal, so the spans are
those of ``[0-9a-f]+`` with shorter ones dropped. The same holds for ``access``: a run too
short after its first AKIA is too short after any later one. ``assign`` keeps its pattern
and drops short values afterwards, since a dropped match still uses up its text.

Counting is two-stage: (value, owner, repository) rows are made distinct first, so a value
that a third of all documents share is counted from its owners. Values are joined back to
documents with the few values that very many documents hold dealt over salts.

Edge cases: null text is empty (no spans); a null source is one owner of its own; rows with
one doc_id and one text are scanned each and have equal results; an empty table gives no
rows; other columns are ignored. Whole texts are scanned whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import stored, text_or_empty

#: a private key up to its END line, or without one the runs of base64 after its header; group 1 is the body
PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"""([^-]*+(?:-(?!----)[^-]*+){0,16}+(?=-----END [A-Z ]{0,20}PRIVATE KEY-----)|(?:(?:[\s"',+#>*|]|\\[nrt])*+[A-Za-z0-9+/=]{16,}+)*+)"""
    r"(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
)
#: fixed values of the contract (base kinds) and public key formats (added kinds): kind, pattern, group of the value, least length of the value
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", PEM, 1, 0),
)
#: cheap tests that every match of a kind passes
HINT = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{12}",
    "hex": "[0-9a-f]{32}",
    "forge": "gh[pousr]_",
    "chat": "xox[abprs]-",
    "webtoken": r"eyJ",
    "pem": "-----BEGIN ",
}
#: owners from which on a value is an example that people copy
SHARED_OWNERS = 3
#: rows of one value from which on it is dealt over SALTS tasks in the join back
HOT_ROWS, SALTS = 2_000, 64
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def _spans(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans in code points: the text between matches and the matches themselves give running offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("len"), values.alias("value"))
    pieces = F.filter(pieces, lambda p: p["len"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (start + p["len"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["len"]).alias("at"), F.when(F.length(p["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(SPAN)
    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(HINT[kind]), walked).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, repo, key (hash of the text), and the spans of base and added kinds in order of start, then kind."""
    text = text_or_empty()
    kinds = [*BASE, *ADDED]
    out = docs.select("doc_id", F.col("source").alias("repo"), text.alias("text"))
    out = out.select("doc_id", "repo", F.xxhash64("text").alias("key"), *[_spans(F.col("text"), i, *k).alias(k[0]) for i, k in enumerate(kinds)])
    joined = lambda names: F.array_sort(F.concat(*names))
    return out.select("doc_id", "repo", "key", joined([k[0] for k in BASE]).alias("base"), joined([k[0] for k in ADDED]).alias("added"))


def _value(span: Column) -> Column:
    """What owners are counted of; empty for a header without a key."""
    return F.when(span["kind"] == "pem", F.regexp_replace(span["value"], r"""[\s"']\+[\s"']|\\[nrt]|[^A-Za-z0-9+/=]""", "")).otherwise(span["value"])


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """value_hash, n_docs, n_repos, n_owners and whether the value is a widely copied example.

    ``found`` has value_hash, repo and n (occurrences in documents), already reduced to one row per value and repository.
    """
    owner = F.split_part(F.coalesce("repo", F.lit("")), F.lit("/"), F.lit(1))
    by_owner = found.groupBy("value_hash", owner.alias("owner")).agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    out = by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_docs"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    return out.withColumn("example", F.col("n_owners") >= shared_owners)


def scan(docs: DataFrame, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """One row per document row: doc_id, base and added spans (the live ones of the added kinds), n_live, n_example."""
    rows = stored(candidates(docs), "secret-candidates")
    spans = F.concat("base", "added")
    # equal rows have equal keys, and are scored once
    keyed = rows.filter(F.size(spans) > 0).select("doc_id", "repo", "key", F.explode(spans).alias("s"))
    keyed = keyed.select("doc_id", "repo", "key", _value(F.col("s")).alias("value"))
    keyed = keyed.filter("value <> ''").withColumn("value_hash", F.xxhash64("value"))
    held = keyed.select("doc_id", "repo", "key", "value_hash").distinct()
    owners = ownership(held.groupBy("value_hash", "repo").agg(F.count("*").alias("n")), shared_owners)
    owners = stored(owners, "secret-owners")

    hot = owners.filter(F.col("n_docs") >= HOT_ROWS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cold = owners.filter(F.col("n_docs") < HOT_ROWS).withColumn("salt", F.lit(-1))
    dealt = held.withColumn("salt", F.explode(F.array(F.lit(-1), F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))))
    judged = dealt.join(hot.unionByName(cold), ["value_hash", "salt"]).select("doc_id", "key", "value_hash", "example")
    per_row = judged.groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("example"), F.col("value_hash"))).alias("examples"))

    per_row = per_row.select(F.col("doc_id").alias("row_id"), F.col("key").alias("row_key"), "examples")
    out = rows.join(per_row, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("key") == F.col("row_key")), "left").select("doc_id", "base", "added", "examples")
    is_example = lambda s: F.array_contains(F.coalesce("examples", F.array().cast("array<bigint>")), F.xxhash64(_value(s)))
    out = out.withColumn("added", F.filter("added", lambda s: ~is_example(s)))
    return out.withColumns({
        "n_example": F.size(F.filter("base", is_example)).cast("long"),
        "n_live": F.size(F.filter(F.concat("base", "added"), lambda s: ~is_example(s))).cast("long"),
    }).drop("examples")


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(k[0]) for k in BASE],
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_example",
        "n_live",
    )
