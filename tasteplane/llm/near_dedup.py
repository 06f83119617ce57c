r"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a document's set is its distinct
``width``-word shingles (with fewer words the whole sequence as one). Two documents are
linked when 100 * |intersection| >= 100 * threshold * |union|; components of links share an id.

1. Sketch. Two permutations of a domain of 2**32 make the whole signature: the first
   scatters the shingles, the second, shifted circularly by k, gives coordinate k as its
   minimum over the set. BANDS * ROWS coordinates: at a similarity of 0.8 a pair escapes
   every band with probability (1 - 0.8**ROWS)**BANDS = 6e-7. Nothing else can lose a link.
2. Copies. Documents with one word sequence form a class; only classes go on, so a group
   of exact copies costs one row however large it is.
3. Buckets. Classes that agree in a band meet in its bucket. One shuffle of (band key, class)
   finds the buckets of two or more, as a run of equal keys. Buckets with the same members
   (the same size and sums of two 64-bit hashes, each in two halves) are looked at once.
4. Blocks. A bucket is dealt into blocks of about BLOCK classes and BLOCK_SHINGLES shingles, by
   a hash of class and bucket, so other buckets mix a group's members in other ways. A task
   holds one block with its full shingle sets, counts intersections exactly, and emits a
   spanning forest of the verified links: fewer rows than members, whatever the group. Classes
   that are known to lie in one component are not compared. First the buckets of a few bands,
   then those of the other bands that still hold several components.
5. Across blocks. In buckets of several blocks that still hold several components, the
   classes outside the bucket's largest component (probes) are compared with all blocks, in the
   same way. What grows with the square of a bucket is the number of its probes alone: classes that no
   chain of links joins to the rest, although they agree in a whole band.
6. Components of the verified links. A task joins the links of its blocks and writes each node with the
   least of its group. Up to LINKS_AT_ONCE of these rows are joined on the driver, more by
   minimum labels with pointer jumping, in tables in the shared folder.

Edge cases: null, empty or blank text has an empty set, is linked with nothing and kept;
repeated rows of one doc_id give a row each, with equal values; a null doc_id never names a
component unless all of its documents have none, and is kept only then; an empty table
gives no rows; very long texts are one set each (8 bytes a shingle in one task); other columns
are ignored, whatever their names. ``deduplicated`` tells rows apart by doc_id and text: of a component the row
of least doc_id (null last), then of least text hash stays, once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tasteplane.llm._shared import BROADCAST_ROWS, arrow_map, discard, may_be_in, release, stored, text_or_empty, unused

THRESHOLD, ROWS, BANDS = 0.8, 5, 36
#: classes and shingles (8 bytes each) of a block
BLOCK, BLOCK_SHINGLES = 2_048, 1_000_000
#: bands whose buckets are looked at first
FIRST_BANDS = 4
#: links (two digests of 16 bytes each) whose components the driver makes by itself
LINKS_AT_ONCE = 200_000
#: word hashes that a Python worker remembers, of words up to so many bytes
_REMEMBERED_WORDS, _REMEMBERED_BYTES = 100_000, 40


def _mix32(y):
    """A bijection of 32-bit numbers with full avalanche, in place."""
    import numpy as np

    y ^= y >> np.uint32(16)
    y *= np.uint32(0x7FEB352D)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x846CA68B)
    y ^= y >> np.uint32(16)
    return y


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are remembered up to a bound."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").lower().split()

    def set_of(self, words: list[bytes]):
        import numpy as np
        import xxhash

        known = self.known
        if len(known) > _REMEMBERED_WORDS:
            known.clear()
        hashes = []
        for w in words:
            if (x := known.get(w)) is None:
                x = xxhash.xxh3_64_intdigest(w)
                if len(w) <= _REMEMBERED_BYTES:
                    known[w] = x
            hashes.append(x)
        h = np.array(hashes, np.uint64)
        width = min(self.width, len(h))
        out = np.full(max(0, len(h) - width + 1) if len(h) else 0, width, np.uint64)
        for k in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : k + len(out)]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles, coordinates: int = ROWS * BANDS):
    """Circulant MinHash of a non-empty set of 64-bit shingle hashes."""
    import numpy as np

    scattered = _mix32((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 2048):
        np.minimum(out, _mix32(shifts + scattered[None, at : at + 2048]).min(axis=1), out=out)
    return out


def band_keys(sig, bands: int = BANDS):
    import numpy as np

    rows = sig.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += rows[:, k]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    # the band is the highest part, so keys of lower bands are smaller
    return (out >> np.uint64(7) | np.arange(bands, dtype=np.uint64) << np.uint64(57)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, fp (digest of the word sequence; null without words), keys (one a band)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            n, fp, keys = [], [], []
            for value in batch.column("text"):
                words = shingler.words(value.as_py())
                if not words:
                    n.append(0), fp.append(None), keys.append(None)
                    continue
                shingles = shingler.set_of(words)
                n.append(len(shingles))
                fp.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(band_keys(signature(shingles)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "fp", "keys"])

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return arrow_map(rows, run, "doc_id long, text_key long, n_shingles long, fp binary, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """fp, shingles (sorted 64-bit hashes, as bytes)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                fp, sets = [], []
                for value in batch.column("text").slice(at, 500):
                    words = shingler.words(value.as_py())
                    fp.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sets.append(shingler.set_of(words).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return arrow_map(docs.select("text"), run, "fp binary, shingles binary")


def _groups(batches, columns: list[str]) -> Iterator:
    """Runs of equal ``columns`` in sorted Arrow batches, as one table each (a run may span batches)."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def spanning_links(sets: list, component: list, probe: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links (by place) that join the components of one block: every pair of a probe and another row is decided
    exactly, unless both are known to lie in one component by then.

    ``sets`` are sorted arrays, ``component`` is any name of each row's component so far.
    """
    import numpy as np

    names: dict = {}
    comp = np.array([names.setdefault(c, len(names)) for c in component])
    if len(names) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    by_size = np.argsort(sizes, kind="stable")
    n, comp, asks = sizes[by_size], comp[by_size], np.array(probe, bool)[by_size]
    ends = np.cumsum(n)
    starts = ends - n
    universe, place = np.unique(np.concatenate([sets[i] for i in by_size.tolist()]), return_inverse=True)
    place = place.astype(np.int32)
    mark = np.zeros(len(universe), np.uint8)
    # sizes that can reach the threshold are neighbours
    first = np.searchsorted(100 * n, percent * n)
    last = np.searchsorted(percent * n, 100 * n, side="right")
    waiting = np.ones(len(n), bool)
    out = []
    members = np.bincount(comp)
    for x in np.lexsort((np.arange(len(n)), members[comp])).tolist():  # the largest component comes last, when little is left to compare it with
        if not asks[x]:
            continue
        waiting[x] = False
        a, b = int(first[x]), int(last[x])
        open_ = waiting[a:b] & (comp[a:b] != comp[x])
        if not open_.any():
            continue
        at = np.flatnonzero(open_)
        a, b = a + int(at[0]), a + int(at[-1]) + 1
        own = place[starts[x] : ends[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[place[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], dtype=np.int32)
        mark[own] = 0
        hit = open_[a - int(first[x]) : b - int(first[x])] & (100 * both >= percent * (n[a:b] + n[x] - both))
        for y in (np.flatnonzero(hit) + a).tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                out.append((int(by_size[x]), int(by_size[y])))
    return out


def least_joined(a: list, b: list) -> dict:
    """The least node that links ``a`` - ``b`` reach from each node (itself, where a node is the least)."""
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    return {x: top(x) for x in above}


def _verified(blocks: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """a, b: what the verified links of each group of ``keys`` join, as the least and any other node (a task may repeat another's rows). ``blocks`` has fp, label, probe and shingles besides."""
    import pyarrow as pa

    percent = round(100 * threshold)

    def stars(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
        joined = [(least, node) for node, least in least_joined(a, b).items() if node != least]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in joined], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        a, b = [], []
        for t in _groups(batches, keys):
            fp = t.column("fp").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            for x, y in spanning_links(sets, t.column("label").to_pylist(), t.column("probe").to_pylist(), percent):
                a.append(fp[x]), b.append(fp[y])
            if len(a) >= 20_000:
                yield stars(a, b)
                a, b = [], []
        yield stars(a, b)

    dealt = blocks.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp")
    return stored(arrow_map(dealt, run, "a binary, b binary"), "links")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members, with ``label``, of the buckets that hold several components."""
    if labels is None:
        return members.withColumn("label", F.col("fp"))
    named = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = named.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one <> two").select("key")
    return named.join(mixed, "key", "left_semi")


def within_blocks(members: DataFrame, labels: DataFrame | None, sets: DataFrame, threshold: float) -> DataFrame:
    rows = _mixed(members, labels).select("key", "block", "fp", "label", F.lit(True).alias("probe"))
    return _verified(rows.join(sets, "fp"), ["key", "block"], threshold)


def across_blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the blocks of one bucket: its probes, in parts, against each of its blocks."""
    named = stored(_mixed(members.filter("blocks > 1"), labels), "members-mixed")
    weighed = named.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    largest = weighed.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max_by("n", F.struct("m", "label")).alias("top_n"))
    parts = F.ceil(F.greatest((F.col("m") - F.col("top.m")) / BLOCK, (F.col("n") - F.col("top_n")) / BLOCK_SHINGLES)).cast("int")
    told = named.join(largest.select("key", F.col("top.label").alias("top"), parts.alias("parts")), "key")
    places = lambda n: F.sequence(F.lit(0), n - 1)
    part = F.pmod(F.xxhash64(F.lit("part"), "fp", "key"), F.col("parts")).cast("int")
    probes = told.filter("label <> top").select("key", part.alias("part"), F.explode(places(F.col("blocks"))).alias("block"), "fp", "label", F.lit(True).alias("probe"))
    others = told.select("key", F.explode(places(F.col("parts"))).alias("part"), "block", "fp", "label", F.lit(False).alias("probe"))
    return _verified(probes.union(others).join(sets, "fp"), ["key", "part", "block"], threshold)


def _joined_at_once(pairs: DataFrame) -> DataFrame:
    import pyarrow as pa

    t, kind = pairs.toArrow(), pairs.schema["a"].dataType
    least = least_joined(*(t.column(c).to_pylist() for c in ("a", "b")))
    rows = pa.table([pa.array(x, t.schema.field("a").type) for x in (list(least), list(least.values()))], ["node", "label"])
    labels = stored(pairs.sparkSession.createDataFrame(rows, StructType().add("node", kind).add("label", kind)), "labels")
    return F.broadcast(labels) if len(least) <= BROADCAST_ROWS else labels


def components(links: DataFrame, known: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """node, label: the least node of each node's component. With ``rounds``, stop early: equal labels then still mean one component.

    ``known`` labels (of an earlier call) contract the graph first, so only what joins components is walked again.
    A graph of up to LINKS_AT_ONCE rows is joined on the driver.
    """
    pairs = links.select("a", "b") if known is None else links.select("a", "b").union(known.select("node", "label"))
    if pairs.count() <= LINKS_AT_ONCE:
        return _joined_at_once(pairs)
    edges = links.select("a", "b").distinct()
    if known is not None:
        one, two = known.select(F.col("node").alias("a"), F.col("label").alias("la")), known.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        mapped = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        edges = mapped.filter("a <> b").distinct()
    both = stored(edges.union(edges.select("b", "a")).distinct(), "links-both-ways")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        rows = labels.select("node", F.col("label").alias("old")).join(near, F.col("node") == F.col("at")).join(over, F.col("old") == F.col("via"))
        lower = F.least("old", "near", "jump")
        lowered = stored(rows.select("node", lower.alias("label"), (lower != F.col("old")).alias("moved")), "labels")
        discard(labels)
        labels = lowered
        done += 1
        if labels.filter("moved").limit(1).count() == 0:
            break
    discard(both)
    labels = labels.select("node", "label")
    if known is None:
        return labels
    further = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    old = known.join(further, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return stored(old.unionByName(labels.join(known.select("node"), "node", "left_anti")), "labels-joined")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, h (hash of a class): the members of buckets of two or more, each set of members once."""
    # a run of equal keys has a neighbour before or after; two classes of one hash are both looked up later, and verified
    banded = classes.select(F.explode("keys").alias("key"), F.xxhash64("fp").alias("h"))
    run = W.partitionBy("key").orderBy("h")
    near = banded.select("key", "h", F.lag("h").over(run).alias("before"), F.lead("h").over(run).alias("after"))
    members = stored(near.filter("before is not null or after is not null").select("key", "h"), "bucket-members")
    release(classes.sparkSession)
    # 32-bit pieces, so that sums stay exact
    who = [F.sum(piece) for h in (F.xxhash64("h"), F.xxhash64(F.lit(1), "h")) for piece in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    told = members.groupBy("key").agg(F.count("*").alias("size"), F.array(*who).alias("who"))
    once = told.groupBy("size", "who").agg(F.min("key").alias("key")).select("key")
    return members.join(once, "key", "left_semi")


def _components(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, fp, label of each row; equal labels are one component (both null without words)."""
    spark = docs.sparkSession
    rows = stored(sketches(docs, width), "sketches")
    with_words = rows.filter(F.col("fp").isNotNull())
    classes = with_words.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes, "classes")
    release(spark)

    placed = stored(_buckets(classes), "buckets")
    involved = stored(classes.select("fp", "rep", "n", F.xxhash64("fp").alias("h")).join(placed.select("h").distinct(), "h", "left_semi"), "involved")
    members = placed.join(involved.select("h", "fp", "n"), "h").select("key", "fp", "n")
    blocks = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    members = stored(members, "block-members")
    discard(placed, classes)
    release(spark)

    reps = involved.select(F.col("rep").alias("_rep")).distinct()
    bodies = may_be_in(docs.select("doc_id", text_or_empty().alias("text")), "doc_id", reps, "_rep")
    bodies = bodies.join(reps, bodies["doc_id"].eqNullSafe(reps["_rep"]), "left_semi")
    sets = stored(shingle_sets(bodies, width).join(involved.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "shingle-sets")
    discard(involved)
    release(spark)

    band = F.shiftright("key", 57)
    links = within_blocks(members.filter(band < FIRST_BANDS), None, sets, threshold)
    labels = components(links)
    discard(links)
    for step in (within_blocks, across_blocks):
        if step is across_blocks and not members.filter("blocks > 1").limit(1).count():
            continue
        chosen = members.filter(band >= FIRST_BANDS) if step is within_blocks else members
        links = step(chosen, labels, sets, threshold)
        labels = components(links, labels)
        discard(links)
        release(spark)
    discard(members, sets)
    return rows.drop("keys").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, width: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    rows = stored(_components(docs, width, threshold), "rows-labelled")
    # a table of its own: sums are then made before rows of one label meet, and AQE can split the join
    smallest = stored(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    out = rows.join(smallest, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with all its columns; of repeated rows one stays."""
    rows = stored(_components(docs, width, threshold).select("doc_id", "text_key", "label"), "rows-labelled")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    first = rows.filter("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    gone = rows.join(first, "label").filter(order != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    again = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    gone, again = stored(gone, "documents-gone"), stored(again, "documents-repeated")
    discard(rows)

    def marked(table: DataFrame, other: DataFrame, how: str) -> DataFrame:
        key, text_key = unused("_id", table), unused("_key", table)
        other = other.select(F.col("_id").alias(key), F.col("_key").alias(text_key))
        return table.join(other, F.col("doc_id").eqNullSafe(other[key]) & (F.xxhash64(text_or_empty()) == other[text_key]), how)

    kept = marked(docs, gone, "left_anti")
    if not again.limit(1).count():
        return kept
    once = marked(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return marked(kept, again, "left_anti").unionByName(once)
