"""Template tree against a plain loop."""

import random
import re

from tasteplane.llm import line_dedup
from tests.llm.fixtures import ROWS, documents


def keys(line):
    """(documents needed, template) of a line."""
    raw = re.findall(r"[^\x20\x09-\x0D]+", line)
    t = ["<*>" if re.search("[0-9]", x) else x for x in raw]
    n = len(t)
    if n < 3 and not (n and len(" ".join(raw).encode()) >= 90):
        return []
    out = [(2 if n >= 50 else 3, (n, 0, *t))]
    k = (n - 2) // 3
    fields = [(i, i + 1) for i in range(2, n)] if 5 <= n < 9 else [(2, 2 + k), (2 + k, 2 + 2 * k), (2 + 2 * k, n)] if n >= 9 else []
    out += [(3, (n, f, *t[:a], *t[b:])) for f, (a, b) in enumerate(fields, 1)]
    return [x for x in out if 2 * sum(w != "<*>" for w in x[1][2:]) >= n]


def brute(rows, min_docs=3):
    """(doc_id, kept text, lines, dropped) of each row; doc_ids with one text each."""
    places, needed = {}, {}
    for r, (doc, text, *_) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            for least, k in keys(line):
                places.setdefault(k, {}).setdefault(r, (doc is None, doc, pos))
                needed[k] = min(least, min_docs)
    first = {k: min(v.values())[1:] for k, v in places.items() if len(v) >= needed[k]}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = {p for p, line in enumerate(lines) if any(k in first and first[k] != (doc, p) for _, k in keys(line))}
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        if gone and not kept.strip(" \t\n\r\x0b\x0c"):
            kept = ""
        out.append((doc, kept, len(lines) if text else 0, len(gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = list(ROWS)
    for d in range(100, 160):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 25))) for _ in range(rng.randint(0, 8))]
        if d % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Page {d} of {d * 3}, printed 2021-{d}")
        if d % 5 == 0:
            lines.append(passage)
        if d % 6 == 0:
            lines.insert(0, f"This article was written by {rng.choice(vocabulary)} for the daily news of our town today")
        if d % 7 == 0:
            lines += ["The end.", "  \t", "a b"]
        rows.append((d, "\n".join(lines), "en", "s", 0, None, None))
    return rows + [(200 + i, f"{passage}\n \n", "en", "s", 0, None, None) for i in range(3)]


def test_equal_to_a_plain_loop(spark):
    rows = corpus()
    out = line_dedup.report(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=str) == brute(rows)


def test_rows_of_numbers_and_short_lines_stay(spark):
    texts = [f"{i} {i + 1} {i * 7}\nTotal {i} {i} {i}\nPosted by {'abcdef'[i]}\nWritten by {'abcdef'[i]}nna for us" for i in range(6)]
    docs = documents(spark, [(i, t, "en", "s", 0, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.report(docs).collect()}
    assert all(got[i][:3] == texts[i].split("\n")[:3] for i in got)
    assert [len(got[i]) for i in range(6)] == [4, 3, 3, 3, 3, 3]


def test_long_passages_repeat_from_two_documents_on(spark):
    passage, unspaced = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), "漢字" * 40
    short = " ".join(passage.split()[:40])
    rows = [(1, f"{passage}\n{short}"), (2, f"own words\n{passage}\n{short}"), (3, unspaced), (4, unspaced), (5, f"x\n{unspaced}"), (None, passage), (None, f"y\n{passage}")]
    got = {(r.doc_id, r.text) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, f"{passage}\n{short}"), (2, f"own words\n{short}"), (3, unspaced), (4, ""), (5, "x"), (None, ""), (None, "y")}
    nameless = spark.createDataFrame([(None, passage), (None, f"y\n{passage}")], "doc_id long, text string")
    assert sum(passage in r.text for r in line_dedup.report(nameless).collect()) == 1  # one copy stays without names, too


def test_very_long_texts(spark):
    line = "a" * 2_000_000
    rows = [(1, f"{line} 1\n{line}\n" + "word " * 200_000), (2, line), (3, line), (4, f"z\n{line}")]
    got = {r.doc_id: (len(r.text), r.n_dropped) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == got[3] == (0, 1) and got[4] == (1, 1) and got[1][1] == 0


def test_stage_keeps_columns_and_one_full_copy(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert 201 not in got and 2 in got and got[2] is None and got[3] == ""  # emptied ones go, empty ones stay
    passage = rows[-1][1].split("\n")[0]
    assert sum(passage in (t or "") for t in got.values()) == 1
    assert line_dedup.report(documents(spark, [])).count() == 0
