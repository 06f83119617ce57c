"""The pipeline against a plain Python version on a small table."""

import random

import pytest

from tasteplane.llm import lang_id
from tasteplane.llm.queries import language_model, vocabulary_path
from tests.llm.fixtures import DOCS, sha
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_native_ops import shingles
from tests.llm.test_near_dedup import brute as brute_near

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(21)
    words = {"en": ["the", "thing", "and", "other", "water", "stone", "river", "because", "through", "house"], "fr": ["les", "dans", "avec", "maison", "rivière", "parce", "toujours", "eau", "pierre", "être"]}
    rows = [(0, None, None, None, 0, None, None), (1, "12345 !!", "en", "s", 0, None, None), (2, "", None, "s", 0, None, None)]
    for d in range(10, 70):
        lang = rng.choice(["en", "fr"])
        lines = [" ".join(rng.choice(words[lang]) + rng.choice(["", "s", "ing", "ment"]) for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 6))]
        if d % 5 == 0:
            lines.append("All rights reserved by the owner")
        rows.append((d, "\n".join(lines), lang, "s", 0, None, None))
    for d in range(70, 80):  # near copies in pairs
        copy = rows[d - 60][1].split(" ")
        copy[len(copy) // 2] = "changed"
        rows.append((d, " ".join(copy), "en", "s", 0, None, None))
    item = " ".join(rng.choices(words["en"], k=30))
    rows[20] = (rows[20][0], rows[20][1] + "\n" + item, *rows[20][2:])
    return rows, [(1, item), (2, None)]


def test_equal_to_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    scored = lang_id.Scorer(language_model(docs)).predict([r[1] for r in rows])
    left = [r for r, (lang, score, strange) in zip(rows, scored, strict=True) if lang != "und" and score >= 0.5 and strange <= 2.4]
    cut = {d: (text, n) for d, text, _, n in brute_lines(left)}
    left = [(r[0], cut[r[0]][0] if cut[r[0]][1] else r[1], *r[2:]) for r in left if not (cut[r[0]][1] and not cut[r[0]][0])]
    stay = {d for d, _, c in brute_near(left, 5) if d == c}
    left = [r for r in left if r[0] in stay]
    tests = [shingles(t) for _, t in items if t]
    left = [r for r in left if not any(q and len(shingles(r[1]) & q) >= 0.8 * len(q) for q in tests)]
    library = Tokenizer.from_file(vocabulary_path())
    library.no_padding()
    library.no_truncation()
    assert got.keys() == {r[0] for r in left}
    for r in left:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]].n_tokens == len(ids) and got[r[0]].ids_sha256 == sha(" ".join(map(str, ids)))
    assert len(left) < len(rows) - 3


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
