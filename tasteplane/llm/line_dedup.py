r"""Line dedup by a log-template tree.

A line walks down a tree of fixed depth: its number of tokens, then its LEADING tokens, where
tokens with a digit are variable from the start and read ``<*>``. The leaf reached holds
templates. A line belongs to the template of all its tokens, and to those that let one field behind
the leading tokens vary: any one token in lines of GENERAL_FROM tokens or more, any third of the rest in lines of
THIRDS_FROM or more. So lines that differ inside one field of words generalise to one template without
being compared in pairs. A similarity step closes the leaf: at least half of all tokens must be
fixed ones that template and line share, so a row of numbers is no template, however often rows of its
length occur. Shorter lines have no variable words: in a large corpus some line always completes two of three words.

A template recurs if at least ``min_docs`` documents hold it, or two if it fixes a passage of LONG_TOKENS tokens or
more word for word. Every line with a recurring template is dropped, except at the template's
first place (least doc_id, then position), so a group of copied documents keeps one full text.

Templates are numbers (hashes of node and fixed tokens). A document names each of its
templates once, counts are summed before they are shuffled, and recurring ones meet their
documents in a shuffled join, which needs no rows of one template together, so that AQE splits the partition of
one that very many documents share; a bounded bit map keeps most rows without a recurring
template out of it. A document's recurring templates then go to its text, which is cut line
by line. The plan is the same at every size.

Edge cases: null text is empty and has no lines to drop; lines under MIN_TOKENS tokens are considered from LONG_BYTES
bytes on (text without spaces); a document of which only blank lines would stay becomes empty; each row counts as a document, repeated
ones too, and rows that share the least doc_id all keep the first place; rows with a null doc_id come after all
others; an empty table gives no rows; very long texts and lines are taken whole; all columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import arrow_map, discard, may_be_in, release, stored, text_or_empty, unused

MIN_DOCS, MIN_TOKENS, LONG_BYTES, LONG_TOKENS = 3, 3, 90, 50
LEADING, GENERAL_FROM, THIRDS_FROM = 2, 5, 9
#: order numbers of documents without a doc_id start here
_NAMELESS = 1 << 62
_DIGIT = re.compile(rb"[0-9]")


def templates(line: bytes) -> list[int]:
    """Numbers of a line's templates; the lowest bit tells those that recur from two documents on."""
    from xxhash import xxh3_64_digest as digest
    from xxhash import xxh3_64_intdigest as number

    tokens = line.split()
    n = len(tokens)
    if n < MIN_TOKENS and (not n or sum(map(len, tokens)) + n - 1 < LONG_BYTES):
        return []
    if _DIGIT.search(line):
        tokens = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
    # the node's leading tokens, then the fields that may vary
    if n >= THIRDS_FROM:
        third = (n - LEADING) // 3
        edges = [0, LEADING, LEADING + third, LEADING + 2 * third, n]
    else:
        edges = [0, *range(min(LEADING, n), n + 1)]
    parts = [tokens[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    variable = [p.count(b"<*>") for p in parts] if b"<*>" in tokens else [0] * len(parts)
    names = [digest(b" ".join(p)) for p in parts]
    node, fixed = b"%d\0" % n, n - sum(variable)
    out = []
    if 2 * fixed >= n:
        h = number(node + b"".join(names))
        out.append((h | 1 if n >= LONG_TOKENS else h & ~1) - (1 << 63))
    if n >= GENERAL_FROM:
        for field in range(1, len(parts)):
            if 2 * (fixed - len(parts[field]) + variable[field]) >= n:
                h = number(b"%s%d\0%s%s" % (node, field, b"".join(names[:field]), b"".join(names[field + 1 :])))
                out.append((h & ~1) - (1 << 63))
    return out


def _row_key():
    return F.xxhash64("doc_id", text_or_empty())


def document_templates(docs: DataFrame) -> DataFrame:
    """key (a template), row (hash of doc_id and text), place (order of documents): one row for each template of each document row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keys, rows, places = [], [], []

            def full():
                sizes = [len(k) for k in keys]
                columns = [np.concatenate(keys) if keys else np.zeros(0, np.int64), np.repeat(np.array(rows, np.int64), sizes), np.repeat(np.array(places, np.int64), sizes)]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "row", "place"])

            held = 0
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                found = {k for line in text.as_py().encode("utf-8", "surrogatepass").split(b"\n") for k in templates(line)}
                if not found:
                    continue
                keys.append(np.fromiter(found, np.int64, len(found)))
                rows.append(row)
                places.append(_NAMELESS + (row & (_NAMELESS - 1)) if doc is None else doc)
                held += len(found)
                if held > 100_000:
                    yield full()
                    keys, rows, places, held = [], [], [], 0
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), text_or_empty().alias("text"))
    return arrow_map(rows, run, "key long, row long, place long")


def recurring_templates(named: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Of ``document_templates``: key, n (documents), first (order number of the document that keeps it)."""
    counted = named.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    long = F.col("key").bitwiseAND(F.lit(1)) == 1
    return counted.filter(F.col("n") >= F.when(long, min(2, min_docs)).otherwise(min_docs))


def dropped_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """row, gone (templates whose lines go), kept (templates of which the topmost line stays)."""
    named = stored(document_templates(docs), "document-templates")
    recurring = stored(recurring_templates(named, min_docs), "recurring-templates")
    release(docs.sparkSession)
    rows = may_be_in(named, "key", recurring.select(F.col("key").alias("wanted")), "wanted")
    found = rows.join(recurring, "key")
    own = F.col("place") == F.col("first")
    out = stored(found.groupBy("row").agg(F.collect_set(F.when(~own, F.col("key"))).alias("gone"), F.collect_set(F.when(own, F.col("key"))).alias("kept")), "dropped-templates")
    discard(named, recurring)
    release(docs.sparkSession)
    return out


def cut(text: str, gone: set[int], kept: set[int]) -> tuple[str, int]:
    """What stays of a text, and how many lines go."""
    out, n, seen = [], 0, set()
    for line in text.split("\n"):
        names = templates(line.encode("utf-8", "surrogatepass"))
        if any(k in gone or k in seen for k in names):
            n += 1
        else:
            out.append(line)
        seen.update(k for k in names if k in kept)
    left = "\n".join(out)
    return (left if not n or left.strip(" \t\n\r\x0b\x0c") else ""), n


def deduplicated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` with the text cut to the lines that stay, and two columns after them: numbers of lines, and of those dropped (their names follow)."""
    import pyarrow as pa

    n_lines, n_dropped, row, gone, kept = (unused(c, docs) for c in ("_n_lines", "_n_dropped", "_row", "_gone", "_kept"))
    marks = dropped_templates(docs, min_docs).select(F.col("row").alias(row), F.col("gone").alias(gone), F.col("kept").alias(kept))
    joined = docs.join(marks, _row_key() == F.col(row), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone, kept)
    names, at = docs.columns, docs.columns.index("text")
    schema = docs.select(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names]).schema.add(n_lines, "long").add(n_dropped, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            own, away = batch.column(len(names)), batch.column(len(names) + 1)
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                lines.append(text.count("\n") + 1 if text else 0)
                n = 0
                if own[i].is_valid:
                    text, n = cut(text or "", set(own[i].as_py()), set(away[i].as_py()))
                texts.append(text)
                dropped.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, n_lines, n_dropped])

    return arrow_map(joined, run, schema), n_lines, n_dropped


def report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped."""
    out, n_lines, n_dropped = deduplicated_lines(docs.select("doc_id", "text"), min_docs)
    return out.select("doc_id", text_or_empty().alias("text"), F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with recurring lines dropped; those of which nothing stays are left out, those that were empty before stay."""
    out, _, n_dropped = deduplicated_lines(docs, min_docs)
    return out.filter((F.col(n_dropped) <= 0) | (F.length("text") > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
