"""Delta-maintained token counts.

``TokenLedger`` keeps additive totals (documents, tokens, characters) by source, language
and tokenizer version. A batch is a set of signed rows: +1 inserts a count, -1 takes one
back, and a revised count is a -1 of the old and a +1 of the new. A batch is first reduced
to one row per key (partial sums before the shuffle, so a hot source costs nothing) and written
in full to a folder of its own attempt; renaming that folder to the batch's name is the commit, which the
file system grants to one writer and which shows all of the batch or nothing. Sending a committed
batch again changes nothing; a writer that dies at any moment leaves an attempt that nobody reads.

``compact`` sums the committed batches into a snapshot that also lists them, committed in the same way;
totals then read the last snapshot and the batches after it, so their cost does not grow with the ledger's age.

Edge cases: a null text counts as empty (0 tokens, 0 characters, still a document); null
source or language is a key of its own (null); repeated rows count as often as they occur;
an empty batch commits and adds nothing; very long texts are counted whole; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.llm._shared import file_system, scratch, text_or_empty

#: Counting rules by version. Each is a column over the text.
TOKENIZERS = {
    # runs of non-space
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    # runs of letters, single digits, single other signs
    "pieces-1": lambda text: F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]")),
}
#: versions that a vocabulary defines are counted by ``counted_by_vocabulary``
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


def counted(docs: DataFrame, versions: list[str], sign: int | Column = 1) -> DataFrame:
    """Signed count rows of documents, one for each tokenizer version, in one pass over the text."""
    text = text_or_empty()
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), TOKENIZERS[v](text).cast("long").alias("n")) for v in versions])
    s = F.lit(sign) if isinstance(sign, int) else sign
    rows = docs.select("source", "lang", s.cast("long").alias("sign"), F.length(text).cast("long").alias("chars"), F.explode(each).alias("c"))
    return rows.select("source", "lang", F.col("c.tokenizer").alias("tokenizer"), F.col("sign").alias("n_docs"), (F.col("sign") * F.col("c.n")).alias("n_tokens"), (F.col("sign") * F.col("chars")).alias("n_chars"))


def counted_by_vocabulary(docs: DataFrame, version: str, spec: str, sign: int = 1) -> DataFrame:
    """Signed count rows under a public tokenizer's vocabulary, encoded by ``bpe``; ``version`` names it in the totals."""
    from tasteplane.llm import bpe

    rows = docs.select("source", "lang", F.length(text_or_empty()).cast("long").alias("chars"), F.monotonically_increasing_id().alias("doc_id"), text_or_empty().alias("text"))
    held = bpe.tokenized(rows, spec, keep=["source", "lang", "chars"])
    s = F.lit(sign).cast("long")
    return held.select("source", "lang", F.lit(version).alias("tokenizer"), s.alias("n_docs"), (s * F.col("n_tokens")).alias("n_tokens"), (s * F.col("chars")).alias("n_chars"))


def revised(old: DataFrame, new: DataFrame, versions: list[str]) -> DataFrame:
    """Signed rows that replace the counts of the rows of ``old`` by those of ``new``."""
    return counted(old, versions, -1).unionByName(counted(new, versions))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class TokenLedger:
    """Totals in ``path``: attempts/ holds what is being written, batches/<name> the committed deltas, snapshots/<number> their sums."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or scratch(spark, "token-ledger")

    def _names(self, folder: str) -> list[str]:
        fs, where = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def committed(self, batch: str) -> bool:
        fs, where = file_system(self.spark, f"{self.path}/batches/{batch}")
        return fs.exists(where)

    def _commit(self, rows: DataFrame, folder: str, name: str) -> bool:
        """Write under an attempt and rename it to its place; False if another writer was first."""
        attempt = f"{self.path}/attempts/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        fs, _ = file_system(self.spark, attempt)
        jvm = self.spark.sparkContext._jvm
        place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs.mkdirs(place(f"{self.path}/{folder}"))
        target = f"{self.path}/{folder}/{name}"
        try:
            # unlike the older call this one refuses a target that exists
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(attempt).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            files.rename(place(attempt), place(target), options)
        except Exception:
            if fs.exists(place(target)):
                fs.delete(place(attempt), True)
                return False
            raise
        return True

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False (and no work) if ``batch`` is committed already."""
        return not self.committed(batch) and self._commit(summed(deltas), "batches", batch)

    def _snapshot(self) -> tuple[int, list[str]]:
        """Number of the last snapshot (0: none) and the batches that it holds."""
        last = max(map(int, self._names("snapshots")), default=0)
        if not last:
            return 0, []
        return last, [r.batch for r in self.spark.read.schema(SCHEMA + ", batch string").parquet(f"{self.path}/snapshots/{last}").filter("batch is not null").select("batch").collect()]

    def _rows(self) -> tuple[DataFrame, int, list[str], list[str]]:
        last, held = self._snapshot()
        newer = sorted({*self._names("batches")} - {*held})
        paths = [f"{self.path}/batches/{b}" for b in newer] + [f"{self.path}/snapshots/{last}"] * bool(last)
        rows = self.spark.read.schema(SCHEMA + ", batch string").parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA + ", batch string")
        return rows.filter("batch is null").drop("batch"), last, held, newer

    def compact(self) -> bool:
        """Sum all committed batches into a new snapshot; False if there is nothing new or another writer was first."""
        rows, last, held, newer = self._rows()
        if not newer:
            return False
        names = self.spark.createDataFrame([(b,) for b in [*held, *newer]], "batch string")
        return self._commit(summed(rows).unionByName(names, allowMissingColumns=True), "snapshots", str(last + 1))

    def totals(self) -> DataFrame:
        """Sums over the committed batches; keys whose counts have all been taken back are left out."""
        return summed(self._rows()[0]).filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0) | (F.col("n_chars") != 0))


def documents_rollup(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Load all documents, take back the blank ones, revise the counts of texts with blank ends, and count all that stay with a second tokenizer.

    ``load`` inserts every document under words-1. ``retract-blank`` deletes documents
    without a word. ``revise`` replaces the counts of documents whose text begins or ends in white
    space by those of the trimmed text (other characters, the same words). ``recount`` inserts the finer counts of pieces-1.
    ``load`` is then sent again, which must change nothing, and the ledger is compacted.
    """
    ledger = TokenLedger(spark, path)
    blank = ~text_or_empty().rlike(r"[^\x20\x09-\x0D]")
    stay = docs.filter(~blank)
    trim = lambda rows: rows.withColumn("text", F.regexp_replace("text", r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))
    loose = F.col("text").rlike(r"\A[\x20\x09-\x0D]|[\x20\x09-\x0D]\z")
    load = counted(docs, ["words-1"])
    ledger.apply("load", load)
    ledger.apply("retract-blank", counted(docs.filter(blank), ["words-1"], sign=-1))
    old = stay.filter(loose)
    ledger.apply("revise", revised(old, trim(old), ["words-1"]))
    ledger.apply("recount", counted(trim(stay), ["pieces-1"]))
    ledger.apply("load", load)
    ledger.compact()
    return ledger.totals()
