"""Chunk store: exact round trip and features against plain Python."""

import hashlib
import random
import zlib

from tasteplane.llm import media_chunks as m
from tests.llm.fixtures import ROWS, documents


def corpus():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = list(ROWS)
    base = " ".join(rng.choices(vocabulary, k=6000))
    for d in range(100, 130):
        at = rng.randint(0, len(base))
        rows.append((d, base if d % 3 == 0 else base[:at] + "inserted " + base[at:], "en", "s", 0, None, None))
    return rows + [(200, "ab" * 20_000, "en", "s", 0, None, None), (201, "é" * 576, "en", "s", 0, None, None)]


def test_rows_equal_plain_values(spark):
    rows = corpus()
    out = m.media_columns(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        raw = texts[r.doc_id].encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert r.media_bytes == len(pay) + 44 and r.media_sha256 == hashlib.sha256(m.container(pay)).hexdigest() and r.feature == m.features(pay)


def test_shared_chunks_are_stored_once(spark):
    docs = documents(spark, corpus())
    owners, references = m.shared_chunks(m.recipes(docs))
    kept = m.store(docs, owners, references).collect()
    held = [d for r in kept for i, d in enumerate(r.digests) if i not in r.borrowed]
    assert len(held) == len(set(held)) and references.count() > 100
    assert set(held) == {d for r in kept for d in r.digests}


def test_a_store_opens_by_its_path(spark, tmp_path):
    """With a trained dictionary, in a session's later job that knows the path alone."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(800)]
    rows = [(d, " ".join(rng.choices(vocabulary, k=300)), "en", "s", 0, None, None) for d in range(400)]
    rows += [(1000 + d, rows[d][1] + " more " + rows[d + 1][1], "en", "s", 0, None, None) for d in range(40)]
    path = f"{tmp_path}/store"
    first = {r.doc_id: r.media_sha256 for r in m.media_columns(documents(spark, rows), path).collect()}
    packs, references, trained = m.open_store(spark, path)
    assert trained and packs.count() == len({r[1] for r in rows}) and references.count()
    again = m.media_of(spark, path).collect()
    assert {r.media_sha256 for r in again} == set(first.values())
    texts = [m.container(m.payload(r[1])) for r in rows]
    assert {hashlib.sha256(t).hexdigest(): len(m.chunked(t)) for t in texts} == {r.media_sha256: r.n_chunks for r in again}
    assert sum(r.n_borrowed for r in again) == references.count()


def test_cuts_follow_the_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(100_000))
    one, two = m.chunked(data), m.chunked(data[:50_000] + b"!" + data[50_000:])
    assert b"".join(one) == data and all(m.LEAST <= len(c) <= m.MOST for c in one[:-1])
    assert len(set(one) ^ set(two)) <= 6

    gear, h, ends = m._gear().tolist(), 0, []  # one byte at a time
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        if h >> (32 - m.MASK_BITS) == 0:
            ends.append(i + 1)
    at, want = 0, []
    for e in [*ends, len(data)]:
        while e - at > m.MOST:
            at += m.MOST
            want.append(at)
        if e - at >= m.LEAST or e == len(data) and e > at:
            want.append(e)
            at = e
    assert m.cuts(data) == want


def test_empty_table(spark):
    assert m.media_columns(documents(spark, [])).count() == 0
