"""Forward sums against enumeration of all segmentations; held-out accuracy."""

import math
import random
import time

import numpy as np
import pytest

from tasteplane.llm import lang_id
from tests.llm.fixtures import ROWS, documents

LANGS = {"aa": ["th", "er", "ing", "an", "o", "s"], "bb": ["ch", "en", "ung", "ü", "i", "t"], "cc": ["ción", "ar", "o", "que", "ll", "s"]}


def all_segmentations(word, probability, number):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        k = number.get(word[:n], len(number) if n == 1 else None)
        if k is not None:
            total += probability[k] * all_segmentations(word[n:], probability, number)
    return total


def pieces():
    return sorted({"▁", *"abcdefghijklmnopqrstuvwxyzóü", *(p for v in LANGS.values() for p in v), "▁th", "then", "enung", "arque"})


def labelled(spark, n=300):
    rng = random.Random(9)
    rows = []
    for d in range(n):
        lang = rng.choice(list(LANGS))
        words = ["".join(rng.choices(LANGS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((d, " ".join(words).title(), lang, "s", 0, None, None))
    return documents(spark, rows)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    names = pieces()
    number = {p: k for k, p in enumerate(names)}
    p = rng.random(len(names) + 1)
    p /= p.sum()
    words = ["then", "enungarque", "x", "ção", "thething", "日"]
    got = lang_id.Lattice(words, number).totals(p)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, all_segmentations("▁" + w, p, number), rel_tol=1e-12)


def test_em_does_not_lower_the_likelihood():
    counts = {"aa": {"then": 5, "thing": 3, "ether": 2, "soothing": 1}}
    names = pieces()
    number = {p: k for k, p in enumerate(names)}
    score = []
    for rounds in range(1, 6):
        model = lang_id.fit(counts, names, rounds)
        lattice = lang_id.Lattice(sorted(counts["aa"]), number)
        score.append(sum(c * math.log(t) for c, t in zip([counts["aa"][w] for w in sorted(counts["aa"])], lattice.totals(model.probability[0]), strict=True)))
    assert all(b >= a - 0.05 for a, b in zip(score, score[1:], strict=False))


def test_held_out_accuracy_and_edge_rows(spark):
    docs = labelled(spark)
    model = lang_id.train(docs.filter("doc_id % 3 <> 1"), pieces())
    out = lang_id.identified(docs, model)[0].collect()
    assert np.mean([r.lang == r._lang_pred for r in out if r.doc_id % 3 == 1]) > 0.97
    assert all(0 <= r._score <= 1 and r._strange < 2 for r in out)
    edge = {r.doc_id: r for r in lang_id.identified(documents(spark), model)[0].collect()}
    assert len(edge) == len({r[0] for r in ROWS})
    assert all(edge[d]._lang_pred == "und" and edge[d]._score == 0 for d in (2, 3, 4)) and edge[7]._lang_pred in LANGS
    assert lang_id.identified(documents(spark, []), model)[0].count() == 0


def test_number_signs_are_no_letters():
    model = lang_id.fit({"aa": {"then": 3, "thing": 2}, "bb": {"ungen": 2, "chi": 4}}, pieces())
    got = lang_id.Scorer(model).predict(["½ ² ①", "Ⅷ", "12 _ 3", "then½thing", "then thing"])
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3] == got[4] and got[4][0] == "aa"


def test_texts_of_no_learned_language_are_strange(spark):
    rng = random.Random(3)
    model = lang_id.train(labelled(spark), pieces())
    fifth = [" ".join("".join(rng.choices(["zk", "wq", "xy", "jv", "u"], k=3)) for _ in range(80)) for _ in range(20)]
    own = [" ".join("".join(rng.choices(LANGS["bb"], k=3)) for _ in range(n)) for n in (1, 2, 5, 80) for _ in range(20)]
    score = lang_id.Scorer(model).predict
    assert all(g[2] > 2.4 for g in score(fifth)) and all(g[2] < 2.4 for g in score(own))


def test_parts_of_long_texts_end_between_words(monkeypatch):
    model = lang_id.fit({"aa": {"then": 3, "thing": 2}, "bb": {"ungen": 2, "chi": 4}}, pieces())
    text = " ".join(random.Random(5).choices(["then", "ungen", "chith", "thing" * 9, "x1y"], k=300))
    whole = lang_id.Scorer(model).predict([text])[0]
    monkeypatch.setattr(lang_id, "_PART", 7)
    monkeypatch.setattr(lang_id, "_LATTICE_WORDS", 1)
    parts = lang_id.Scorer(model).predict([text])[0]
    assert whole[0] == parts[0] and np.allclose(whole[1:], parts[1:])


def test_labels_are_no_part_of_the_plan(spark):
    rows = [(i, "then thing", f"l{i % 700}", "s", 0, None, None) for i in range(2_000)]
    assert len(lang_id.train(documents(spark, rows), pieces()).languages) == 700


def test_nothing_learned(spark):
    model = lang_id.train(documents(spark, []), pieces())
    assert {r._lang_pred for r in lang_id.identified(documents(spark), model, ["doc_id"])[0].collect()} == {"und"}


def test_memory_of_words_does_not_change_scores(monkeypatch):
    model = lang_id.fit({"aa": {"then": 3, "thing": 2}, "bb": {"ungen": 2, "chi": 4}}, pieces())
    texts = [" ".join(random.Random(i).choices(["then", "ungen", "chith", "thing", "enter", "x"], k=8)) for i in range(50)]
    whole = lang_id.Scorer(model).predict(texts)
    monkeypatch.setattr(lang_id, "_REMEMBERED_WORDS", 2)
    one = lang_id.Scorer(model)
    assert [one.predict([t])[0] for t in texts] == whole


def walked(words, number):
    """Places of pieces, walked one by one: end, word, start, piece."""
    beginnings, out = {p[:i] for p in number for i in range(1, len(p) + 1)}, []
    for w, word in enumerate(words):
        text = "▁" + word
        for i in range(len(text)):
            out.append((i + 1, w, i, number.get(text[i], len(number))))
            j = i + 1
            while j <= len(text) and text[i:j] in beginnings:
                if j > i + 1 and text[i:j] in number:
                    out.append((j, w, i, number[text[i:j]]))
                j += 1
    return sorted(out)


def places(lattice):
    return list(zip(lattice.end.tolist(), lattice.word.tolist(), lattice.start.tolist(), lattice.piece.tolist(), strict=True))


@pytest.mark.parametrize("cells", [lang_id._CELLS, 0])
def test_lattice_has_all_pieces_at_all_places(monkeypatch, cells):
    monkeypatch.setattr(lang_id, "_CELLS", cells)
    rng = random.Random(4)
    words = ["", "x", "日", "\U0001d4d0th", "then", "ing" * 10, *("".join(rng.choices(pieces(), k=4)).replace("▁", "é") for _ in range(300))]
    for names in (pieces(), [*pieces(), "\U0001d4d0t", "日本語", "▁日本"], ["▁"], ["a"], []):
        number = {p: k for k, p in enumerate(names)}
        assert places(lang_id.Lattice(words, number)) == walked(words, number)
        assert places(lang_id.Lattice([], number)) == []
    assert lang_id.fit({"aa": {}, "bb": {"then": 1}}, pieces()).languages == ["aa", "bb"]


def test_lattices_are_made_for_many_words_at_once():
    """A walk place by place was two thirds of the operator's CPU time."""
    rng = random.Random(6)
    number = {p: k for k, p in enumerate(pieces())}
    trie = lang_id.Trie(number)
    words = ["".join(rng.choices(pieces()[:-1], k=6))[:32] for _ in range(8_000)]

    def least(run):
        times = []
        for _ in range(3):
            at = time.process_time()
            run()
            times.append(time.process_time() - at)
        return min(times)

    assert least(lambda: lang_id.Lattice(words, number, trie)) < least(lambda: walked(words, number)) / 3
