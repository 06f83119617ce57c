r"""Media columns: content-defined chunks, deduplicated by digest, and ordered chunk lists.

A text's payload is its UTF-8 bytes, padded with bytes 255 to a positive multiple of 576. It
is stored as 8-bit mono samples in a RIFF/WAVE container (44 bytes of header). The media
bytes are cut where a rolling gear hash of the last 32 bytes meets a mask, so an inserted
byte moves the cuts near it only.

1. Recipes: for every document its media digest and ordered chunk digests (small rows).
2. Digests are joined: of each chunk that several media hold, the least (media, place) is the
   owner; the others keep a reference.
3. Store: one row for each distinct media, with its ordered chunk list and a compressed pack
   of the chunks that it owns. Bytes move once, map-side reduced to one row a media, so copies
   of one text never meet as copies.
4. Reading back: media that own all their chunks are assembled where they lie; for the
   others the lent chunks are joined in by digest. Every chunk is checked against its digest
   and every media against its own, and features are computed from the samples.

Packs are compressed with a dictionary that is trained on a bounded sample of texts and written
beside them, so a later job opens the store by its path alone (``write_store``, ``open_store``,
``media_of``); no result depends on it. The joins on digests need no rows of one digest together, so AQE splits
the partition of a chunk that very many media hold.

A rolling hash over the last 32 bytes is a sum of shifted table values, which five doubling
steps compute for all positions at once. Chunks have LEAST to MOST bytes.

Edge cases: null text is empty (one block of 576 bytes 255); equal texts have equal rows;
repeated rows stay; documents with null ids are kept; an empty table gives no rows; very long texts are one
media each, whole in one task; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.llm._shared import arrow_map, discard, release, remove, scratch, stored, text_or_empty

BLOCK, PAD, RATE = 576, b"\xff", 8_000
LEAST, MASK_BITS, MOST, WINDOW = 512, 11, 8_192, 32
#: packs are compressed with a dictionary from about SAMPLE_DOCS texts (of each at most SAMPLE_CHARS); it only saves space
LEVEL, SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 14, 2_000, 16_384, 112_640


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + PAD * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def container(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM: sizes are little-endian, sample data follow the 44-byte header."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + size]


def _gear():
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks, ascending; the last is the media's length."""
    import numpy as np

    h = _gear()[np.frombuffer(media, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    ends, at = [], 0
    marks = (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    for end in [*marks, len(media)]:
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST or end == len(media) and end > at:
            ends.append(end)
            at = end
    return ends


def chunked(media: bytes) -> list[bytes]:
    out, at = [], 0
    for end in cuts(media):
        out.append(media[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Mean, deviation, mean step and shares of eight equal bands of the samples."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    steps = np.abs(np.diff(x.astype(np.int16))).mean()
    return ",".join(f"{v:.5f}" for v in (x.mean(), x.std(), steps, *shares))


def dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample by hash of doc_id; empty if there is too little text."""
    import zstandard

    n = docs.count()
    span = 1 << 30
    share = int(span * min(1.0, SAMPLE_DOCS / max(1, n)))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(span)) < share)
    texts = [r.t.encode("utf-8", "surrogatepass") for r in sample.select(F.substring(text_or_empty(), 1, SAMPLE_CHARS).alias("t")).limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(t for t in texts if t)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(trained: bytes):
    """(compressor, decompressor)"""
    import zstandard

    data = zstandard.ZstdCompressionDict(trained) if trained else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def media_id(media: bytes) -> bytes:
    return hashlib.blake2b(media, digest_size=16, person=b"media").digest()


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_id, digests (ordered)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, lists = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                media = container(payload(text))
                n.append(len(text.encode("utf-8", "surrogatepass")))
                ids.append(media_id(media))
                lists.append([digest(c) for c in chunked(media)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_id", "digests"])

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_bytes long, media_id binary, digests array<binary>")


def _packed(docs: DataFrame, trained: bytes) -> DataFrame:
    """media_id, z: each media once a batch, compressed."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _codec(trained)
        for batch in batches:
            found = {}
            for value in batch.column("text"):
                media = container(payload(value.as_py()))
                key = media_id(media)
                if key not in found:
                    found[key] = press.compress(media)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["media_id", "z"])

    return arrow_map(docs.select(text_or_empty().alias("text")), run, "media_id binary, z binary")


REFERENCES = "digest binary, media_id binary, seq int"


def shared_chunks(recipe: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of chunks that several places hold: (digest, media_id, seq) of the owner, and of the references, which are written to ``path`` if it is given."""
    media = recipe.groupBy("media_id").agg(F.first("digests").alias("digests"))
    places = media.select("media_id", F.posexplode("digests").alias("seq", "digest"))
    owner = places.groupBy("digest").agg(F.min(F.struct("media_id", "seq")).alias("owner"), F.count("*").alias("n")).filter("n > 1")
    owners = stored(owner.select("digest", F.col("owner.media_id").alias("media_id"), F.col("owner.seq").alias("seq")), "chunk-owners")
    of = owners.select(F.col("digest").alias("_d"), F.col("media_id").alias("_m"), F.col("seq").alias("_s"))
    refs = places.join(of, F.col("digest") == F.col("_d")).filter(~((F.col("media_id") == F.col("_m")) & (F.col("seq") == F.col("_s"))))
    refs = refs.select("digest", "media_id", "seq")
    if not path:
        return owners, stored(refs, "chunk-references")
    refs.write.parquet(path)
    return owners, recipe.sparkSession.read.schema(REFERENCES).parquet(path)


STORE = "media_id binary, n_bytes long, digests array<binary>, sizes array<int>, borrowed array<int>, lent array<int>, pack binary"


def store(docs: DataFrame, owners: DataFrame, references: DataFrame, trained: bytes = b"") -> DataFrame:
    """One row for each distinct media: its ordered chunk list and a pack of the chunks it owns."""
    import pyarrow as pa

    empty = F.array().cast("array<int>")
    marks = references.select("media_id", "seq", F.lit(True).alias("out")).union(owners.select("media_id", "seq", F.lit(False)))
    marks = marks.groupBy("media_id").agg(F.collect_set(F.when(F.col("out"), F.col("seq"))).alias("borrowed"), F.collect_set(F.when(~F.col("out"), F.col("seq"))).alias("lent"))
    media = _packed(docs, trained).groupBy("media_id").agg(F.first("z").alias("z"))
    both = media.join(marks, "media_id", "left").select("media_id", "z", F.coalesce("borrowed", empty).alias("borrowed"), F.coalesce("lent", empty).alias("lent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = _codec(trained)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                media = open_.decompress(r["z"])
                chunks, away = chunked(media), set(r["borrowed"])
                own = r["z"] if not away else press.compress(b"".join(c for i, c in enumerate(chunks) if i not in away))
                rows.append({"media_id": r["media_id"], "n_bytes": len(media), "digests": [digest(c) for c in chunks], "sizes": [len(c) for c in chunks], "borrowed": sorted(away), "lent": sorted(r["lent"]), "pack": own})
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow_store())

    return arrow_map(both, run, STORE)


def _arrow_store():
    import pyarrow as pa

    ints = pa.list_(pa.int32())
    return pa.schema([("media_id", pa.binary()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", ints), ("borrowed", ints), ("lent", ints), ("pack", pa.binary())])


def _own_chunks(row: dict, open_) -> dict[int, bytes]:
    """The chunks of a store row's pack by place, each checked against its digest."""
    data, at, out = open_.decompress(row["pack"]), 0, {}
    away = set(row["borrowed"])
    for i, (size, want) in enumerate(zip(row["sizes"], row["digests"], strict=True)):
        if i not in away:
            out[i] = data[at : at + size]
            at += size
            if digest(out[i]) != want:
                raise ValueError(f"chunk {i} of media {row['media_id'].hex()} does not have its digest")
    return out


def lent_chunks(kept: DataFrame, trained: bytes = b"") -> DataFrame:
    """digest, chunk (compressed) of the chunks that other media refer to."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = _codec(trained)
        for batch in batches:
            names, chunks = [], []
            for r in batch.to_pylist():
                own = _own_chunks(r, open_)
                names += [r["digests"][i] for i in r["lent"]]
                chunks += [press.compress(own[i]) for i in r["lent"]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])

    return arrow_map(kept.filter(F.size("lent") > 0).drop("n_bytes", "parts"), run, "digest binary, chunk binary")


def read_back(kept: DataFrame, references: DataFrame, trained: bytes = b"") -> DataFrame:
    """media_id and what is computed from the reassembled, verified media."""
    import pyarrow as pa

    parts = references.select("digest", "media_id", "seq").join(lent_chunks(kept, trained), "digest")
    parts = parts.groupBy(F.col("media_id").alias("_m")).agg(F.collect_list(F.struct("seq", "chunk")).alias("parts"))
    whole = kept.filter(F.size("borrowed") == 0).withColumn("parts", F.array().cast("array<struct<seq:int,chunk:binary>>"))
    mended = kept.filter(F.size("borrowed") > 0).join(parts, F.col("media_id") == F.col("_m")).select(*kept.columns, "parts")
    schema = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, n_borrowed int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, open_ = _codec(trained)
        names = ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "n_borrowed"]
        types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                chunks = _own_chunks(r, open_) | {p["seq"]: open_.decompress(p["chunk"]) for p in r["parts"]}
                media = b"".join(chunks[i] for i in range(len(r["sizes"])))
                if media_id(media) != r["media_id"]:
                    raise ValueError(f"media {r['media_id'].hex()} was not reconstructed")
                back = samples_of(media)
                rows.append((r["media_id"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(r["sizes"]), len(r["borrowed"])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return arrow_map(whole.unionByName(mended), run, schema)


def write_store(docs: DataFrame, recipe: DataFrame, path: str) -> None:
    """The packs of all media of ``docs`` (whose ``recipes`` are ``recipe``) and the dictionary that opens them, in ``path``."""
    spark, trained = docs.sparkSession, dictionary(docs)
    owners, references = shared_chunks(recipe, f"{path}/references")
    release(spark)
    spark.createDataFrame([(trained,)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    store(docs, owners, references, trained).write.parquet(f"{path}/packs")
    discard(owners)
    release(spark)


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bytes]:
    """(packs, references, dictionary) of a store that any job has written."""
    packs = spark.read.schema(STORE).parquet(f"{path}/packs")
    references = spark.read.schema(REFERENCES).parquet(f"{path}/references")
    return packs, references, bytes(spark.read.parquet(f"{path}/dictionary").first()[0])


def media_of(spark: SparkSession, path: str) -> DataFrame:
    """media_id, what is computed from each stored media, reassembled and verified, and its numbers of chunks and of borrowed ones."""
    return read_back(*open_store(spark, path))


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document row: n_bytes and the columns of ``media_of``. The store stays in ``path``; without one it goes once it is read back."""
    spark = docs.sparkSession
    recipe = stored(recipes(docs), "media-recipes")
    at = path or scratch(spark, "media-store")
    write_store(docs, recipe, at)
    found = stored(media_of(spark, at), "media-read-back")
    if not path:
        remove(spark, at)
    named = recipe.select("doc_id", "n_bytes", F.col("media_id").alias("_id"))
    return named.join(found, F.col("_id") == F.col("media_id")).drop("_id", "media_id")
