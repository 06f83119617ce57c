"""Base spans against the plain patterns; labelers, EM and the classifier on made rows."""

import random
import re
from collections import Counter

import numpy as np

from tasteplane.llm import pii
from tests.llm.fixtures import ROWS, documents, sha

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@x.yz", ".", "..", "1", "255", "256", "10.0.0.1", "0001", "4539148803436467", "4539 1488 0343 6467", "-", " ", "+", "+1 (415) 555-2671", "(", ")", "_", "%", "é", "٣", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    for _, text, *_ in ROWS:
        assert pii.base_spans(text or "") == plain(text or "")


def test_long_runs_take_linear_work():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 200_000):
        pii.base_spans(text)


def test_table(spark):
    rng = random.Random(2)
    rows = list(ROWS)
    for d in range(100, 400):
        words = rng.choices(["the", "river", "and", "stone", "page", "was"], k=12)
        words.insert(4, rng.choice(["please call (415) 555-2671 today", "order no. 415-555-2671x", "write to joe [at] mail [dot] com", "Dear Mr. John Smith, hello", "mail a.b@c.com now", "ip 10.1.2.3 is", "+44 20 7946 0958", ""]))
        rows.append((d, " ".join(words), "en", "s", 0, None, None))
    out = pii.found(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {}
    for d, text, *_ in rows:
        texts[d] = text or ""
    for r in out:
        base = plain(texts[r.doc_id])
        n = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in range(4)) and r.base_sha256 == sha(pii.joined(base))
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in r.spans.split(",") if x)]
        assert order == sorted(order) and len(order) == len(base) + r.n_added
    calls = [r for r in out if "please call" in texts[r.doc_id]]
    assert calls and all(r.n_added == 1 for r in calls)
    assert all(r.n_added == 0 for r in out if not re.search(r"call|\[at\]|Mr\.|order", texts[r.doc_id]))
    assert pii.found(documents(spark, [])).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    right = (0.95, 0.9, 0.8, 0.6, 0.9)
    counts = Counter()
    for y in truth:
        code = 0
        for q in right:
            says = y if rng.random() < q else not y
            code = 3 * code + (1 if rng.random() < 0.3 else 2 if says else 0)
        counts[0, code] += 1
    rows = [(k, c, n) for (k, c), n in counts.items()]
    yes, no, share, _ = pii.reliabilities(rows)
    assert abs(share[0] - 0.4) < 0.03
    for i, q in enumerate(right):
        assert abs(yes[0][i][2] / (yes[0][i][2] + yes[0][i][0]) - q) < 0.03 and abs(no[0][i][0] / (no[0][i][2] + no[0][i][0]) - q) < 0.03


def test_kinds_have_reliabilities_of_their_own():
    """A labeler that is right about one kind and guesses about another."""
    rng = np.random.default_rng(4)
    counts = Counter()
    for kind, right in ((0, (0.95, 0.9, 0.9, 0.9, 0.9)), (1, (0.95, 0.5, 0.9, 0.9, 0.9))):
        for y in rng.random(8_000) < 0.5:
            code = 0
            for q in right:
                code = 3 * code + (2 if (y if rng.random() < q else not y) else 0)
            counts[kind, code] += 1
    yes, *_ = pii.reliabilities([(k, c, n) for (k, c), n in counts.items()])
    assert yes[0][1][2] > 0.85 and abs(yes[1][1][2] - 0.5) < 0.05


def test_context_is_whole_words_and_names_come_from_gazetteer_or_address():
    spans = lambda text: [text[s:e] for k, s, e in pii.further(text, pii.base_spans(text)) if k == 5]
    assert spans("My name is Anna Schmidt. Later Klaus Weber came; the Old Town did not.") == ["Anna Schmidt", "Klaus Weber"]
    assert spans("Shannon Anna Bell") == ["Anna Bell"] and spans("xMr Bell") == []
    assert spans("Zora Quill") == [] and [k for k, *_ in pii.further("Zora Quill", [], frozenset({"zora"}))] == [5]
    vote = lambda text, span, kind: pii.votes(text, kind, text.index(span), text.index(span) + len(span)) // 9 % 3
    assert vote("the ship 10.0.0.1", "10.0.0.1", 1) == 1 and vote("the ip 10.0.0.1", "10.0.0.1", 1) == 2
    assert vote("hotel +1 415 555 2671", "+1 415 555 2671", 3) == 1 and vote("tel. +1 415 555 2671", "+1 415 555 2671", 3) == 2


def test_candidates_touch_no_base_span():
    rng = random.Random(7)
    bits = ["Anna Bell ", "a.b@c.com ", "Mr Bell ", "415-555-2671 ", "10.0.0.1 ", "joe [at] mail [dot] com ", "+1 415 555 2671 ", "x ", "123-45-6789 "]
    for _ in range(3_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 10)))
        base = pii.base_spans(text)
        more = pii.further(text, base)
        assert all(e <= a or b <= s for _, s, e in more for _, a, b in base) and all(x[2] <= y[1] for x, y in zip(more, more[1:], strict=False))
    text = "a.b@c.com Anna Bell " * 30_000  # in linear time
    assert len(pii.further(text, pii.base_spans(text))) == 30_000


def test_classifier_follows_soft_labels():
    a, b = 0, 1
    coef = pii.classifier([a, b], [0.9, 0.1], [500.0, 500.0])
    z = pii._design([a, b]) @ coef
    assert z[0] > 0 > z[1]
