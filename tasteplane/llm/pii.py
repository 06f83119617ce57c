r"""Personal data by weak supervision: labelers vote, EM weighs them, a trained classifier decides.

One pass finds base spans (the contract's patterns, in linear time) and further candidates:
national phone numbers, spelled-out e-mail addresses, social-security shaped numbers, and
names after a form of address or with a given name of the gazetteer. Five labelers vote on every
candidate (yes, no, abstain): strict format, gazetteer, whole context words, misleading context, and
what touches the span. Gazetteers are parameters; the given names at hand are everyday ones of four languages.
Votes and features are small codes, so Spark reduces all candidates of the corpus to counts
by (kind, votes, features); their number is bounded by the codes, whatever the corpus.

On those counts the driver runs expectation-maximisation (a labeler has, for each kind, a reliability for
true and for false candidates, drawn towards its reliability over all kinds where a kind has few
candidates; each kind has a share of true ones) and fits a logistic regression
from features to the resulting soft labels: the final span classifier, which needs no votes.
Candidates it accepts become spans; base spans stay in any case.

Edge cases: null text is empty (no spans); repeated rows get equal rows; an empty table or
one without candidates gives rows without added spans; a null doc_id stays null; other columns are ignored,
whatever their names. Whole texts are scanned, whatever their length, in time in proportion to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import arrow_map, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone", "ssn", "person")
BASE_KINDS = KINDS[:4]
Span = tuple[int, int]

# fixed values of the contract
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS_DOTS = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# further candidates
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPELLED = re.compile(r"([A-Za-z0-9._-]{1,64}) ?[\[(]at[\])] ?([A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+)")
_NAME = re.compile(r"\.? ((?:[A-ZÀ-Þ][a-zß-ÿ'-]{1,20} ?){1,3})")
_FULL_NAME = re.compile(r"([A-ZÀ-Þ][a-zß-ÿ'-]{1,20}) (?=([A-ZÀ-Þ][a-zß-ÿ'-]{1,20}))")
ADDRESSED = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora", "my name is", "je m'appelle", "mein Name ist", "me llamo")
#: a form of address begins a word; its first letter may have either case
_ADDRESSED = re.compile(r"(?<!\w)(?:" + "|".join(f"[{w[0].upper()}{w[0].lower()}]{re.escape(w[1:])}" for w in ADDRESSED) + r")(?=[. ])")
CONTEXT = {
    "email": ("mail", "email", "e-mail", "mails", "contact", "write to", "correo", "courriel", "schreib", "schreiben"),
    "ip": ("ip", "ipv4", "host", "server", "address", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta", "iban"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax", "handy", "telefon", "appelez", "téléphone", "llame", "llamar", "teléfono"),
    "ssn": ("ssn", "social", "insurance", "sécurité", "seguridad", "sozialversicherung"),
    "person": ("dear", "sincerely", "regards", "name", "call", "signed", "liebe", "lieber", "cher", "chère", "querido", "querida"),
}
MISLEADING = ("version", "release", "page", "section", "chapter", "isbn", "order no", "fig", "no", "nr", "§")
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)") for k, v in CONTEXT.items()}
_MISLEADING = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, MISLEADING)) + r")(?!\w)")
#: frequent top-level domains of the public root zone
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro io co ai app dev me tv us ca mx br ar cl pe ve uk ie fr de at ch it es pt nl be lu dk se no fi is pl cz sk hu ro bg gr tr ru ua eu il ae sa eg za ng ke in pk cn jp kr tw hk sg my th vn id ph au nz".split())
#: everyday given names (English, German, French, Spanish), lower-case
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle dorothy carol amanda melissa deborah laura anna julia "
    "peter hans karl klaus wolfgang jürgen stefan andreas uwe dieter heinz günther monika petra sabine ursula renate claudia birgit heike maria marie katrin lukas leon felix jonas "
    "jean pierre michel philippe alain nicolas jacques françois louis antoine claire sophie camille emma nathalie isabelle sylvie catherine chloé léa manon jeanne "
    "josé juan carlos luis antonio francisco javier manuel jesús miguel alejandro diego pablo carmen ana isabel dolores pilar teresa rosa lucía sofía elena marta paula jose lucia sofia".split()
)
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "22")

LABELERS = 5


def emails(text: str) -> list[Span]:
    """The contract's pattern, from each @ outwards: the run before it is the local part."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _DIGITS_DOTS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, ends, at = m[0].split("."), [], m.start()
        for p in parts:
            ends.append(at + len(p))
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((ends[i] - len(parts[i]), ends[i + 3]))
            i += 4
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *s) for s in emails(text)]
    if any(map(text.__contains__, "0123456789")):
        out += [(1, *s) for s in ips(text)] + [(2, *s) for s in cards(text)]
        if "+" in text:
            out += [(3, *s) for s in phones(text)]
    return out


def further(text: str, taken: list[tuple[int, int, int]], names: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span and no earlier candidate."""
    found = []
    if any(map(text.__contains__, "0123456789")):
        found += [(3, *m.span()) for m in _NATIONAL.finditer(text)] + [(4, *m.span()) for m in _SSN.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    for word in _ADDRESSED.finditer(text):
        if m := _NAME.match(text, word.end()):
            found.append((5, m.start(1), m.start(1) + len(m[1].rstrip())))
    found += [(5, m.start(), m.end(2)) for m in _FULL_NAME.finditer(text) if m[1].lower() in names and not text[m.start() - 1 : m.start()].isalnum()]
    out: list[tuple[int, int, int]] = []
    busy, at = sorted((s, e) for _, s, e in taken), 0
    reach = 0  # the furthest end of the base spans that begin before a candidate does
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0], -x[2])):
        while at < len(busy) and busy[at][0] <= s:
            reach = max(reach, busy[at][1])
            at += 1
        if (not out or s >= out[-1][2]) and reach <= s and (at == len(busy) or busy[at][0] >= e):
            out.append((kind, s, e))
    return out


def votes(text: str, kind: int, s: int, e: int, names: frozenset[str] = GIVEN_NAMES) -> int:
    """Votes of all labelers, one digit (0 no, 1 abstain, 2 yes) each."""
    name, span = KINDS[kind], text[s:e]
    before, after = text[max(0, s - 40) : s].lower(), text[e : e + 20].lower()
    left, right = text[s - 1 : s], text[e : e + 1]
    digits = "".join(c for c in span if c in "0123456789")

    def strict() -> int:
        if name == "email":
            return 2 if "@" in span and ".." not in span and not span.startswith((".", "-")) else 1
        if name == "ip":
            return 2 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else 0
        if name == "card":
            return 2 if len(digits) in (13, 14, 15, 16) else 1
        if name == "phone":
            return 2 if span.startswith("+") and len(digits) >= 10 else 1
        if name == "ssn":
            return 0 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 2
        return 2 if " " in span else 1

    def listed() -> int:
        if name == "email":
            return 2 if re.split(r"[^a-z]+", span.lower())[-1] in TOP_LEVEL else 1
        if name == "ip":
            return 0 if span.startswith(("0.", "255.")) else 2
        if name == "card":
            return 2 if digits.startswith(CARD_PREFIXES) else 0
        if name == "phone":
            return (2 if digits.startswith(DIAL_CODES) else 0) if span.startswith("+") else 1
        if name == "person":
            return 2 if span.split(" ")[0].lower() in names else 1
        return 1

    context = 2 if _CONTEXT[name].search(before) or _CONTEXT[name].search(after) else 1
    misled = 0 if _MISLEADING.search(before[-14:]) else 1
    touched = 0 if (left.isalnum() or right.isalnum() or left in "./-_#" and left or right in "/_" and right) else 2
    code = 0
    for v in (strict(), listed(), context, misled, touched):
        code = 3 * code + v
    return code


#: ranges of the features; their product bounds the number of different codes
FEATURES = (len(KINDS), 4, 4, 4, 3, 3, 2)


def features(text: str, kind: int, s: int, e: int) -> int:
    """Length, share of digits, separators and surroundings of a span, as one code."""
    span = text[s:e]

    def side(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2

    digits = sum(c in "0123456789" for c in span)
    values = (kind, min(3, len(span) // 8), 4 * digits // (len(span) + 1), min(3, sum(not c.isalnum() for c in span)), side(text[s - 1 : s]), side(text[e : e + 1]), int(span[:1].isupper()))
    code = 0
    for v, top in zip(values, FEATURES, strict=True):
        code = code * top + v
    return code


def _decode(code: int) -> list[int]:
    out = []
    for top in reversed(FEATURES):
        out.append(code % top)
        code //= top
    return out[::-1]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SPANS = "array<struct<kind:int,start:int,end:int,votes:int,features:int>>"


def candidates(docs: DataFrame, names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """doc_id, base_sha256, base, added (candidates with votes and features)."""
    import pyarrow as pa

    span = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "votes", "features")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, base, added = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                found = base_spans(text)
                more = further(text, found, names)
                shas.append(hashlib.sha256(joined(found).encode()).hexdigest())
                for spans, out in ((found, base), (more, added)):
                    out.append([{"kind": k, "start": s, "end": e, "votes": votes(text, k, s, e, names), "features": features(text, k, s, e)} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shas, pa.string()), pa.array(base, span), pa.array(added, span)], ["doc_id", "base_sha256", "base", "added"])

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, f"doc_id long, base_sha256 string, base {SPANS}, added {SPANS}")


#: candidates that a labeler's reliability over all kinds counts for in a kind's own
POOLED = 20.0


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 40):
    """EM over (kind, votes, count): P(vote | true) and P(vote | false) by kind and labeler, share of true by kind, and each row's posterior."""
    import numpy as np

    kind = np.array([c[0] for c in counts])
    n = np.array([c[2] for c in counts], float)
    v = np.array([[c[1] // 3**i % 3 for i in range(LABELERS - 1, -1, -1)] for c in counts])
    balance = (v == 2).sum(axis=1) - 1.5 * (v == 0).sum(axis=1)
    truth = 1 / (1 + np.exp(-balance))
    for _ in range(rounds):
        tables = []
        for y in (truth, 1 - truth):
            of_kind = np.stack([np.bincount(3 * kind + v[:, i], n * y, 3 * len(KINDS)).reshape(len(KINDS), 3) for i in range(LABELERS)], axis=1)
            pooled = of_kind.sum(axis=0) + 1
            table = of_kind + POOLED * pooled / pooled.sum(axis=1, keepdims=True)
            tables.append(table / table.sum(axis=2, keepdims=True))
        share = (np.bincount(kind, n * truth, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        yes, no = (np.log(t)[kind[:, None], np.arange(LABELERS), v].sum(axis=1) for t in tables)
        odds = yes - no + np.log(share[kind] / (1 - share[kind]))
        truth = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return tables[0], tables[1], share, truth


def _design(codes: list[int]):
    import numpy as np

    x = np.zeros((len(codes), 1 + sum(FEATURES)))
    x[:, 0] = 1
    for row, code in enumerate(codes):
        at = 1
        for value, top in zip(_decode(code), FEATURES, strict=True):
            x[row, at + value] = 1
            at += top
    return x


def classifier(codes: list[int], soft: list[float], weight: list[float], ridge: float = 1.0, steps: int = 25):
    """Coefficients of a logistic regression on soft labels, by Newton steps."""
    import numpy as np

    x, y, w = _design(codes), np.array(soft), np.array(weight)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (w * (y - p)) - ridge * b
        curve = (x.T * (w * p * (1 - p))) @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(curve, slope)
    return b


def accepted_features(rows: DataFrame) -> list[int]:
    """Feature codes that the trained classifier accepts; ``rows`` has base and added candidates."""
    import numpy as np

    each = rows.select(F.explode(F.concat("base", "added")).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    counts = each.collect()  # bounded by the codes
    if not counts:
        return []
    *_, truth = reliabilities([(r.kind, r.votes, r.n) for r in counts])
    labels: dict[int, list[float]] = {}
    for r, t in zip(counts, truth.tolist(), strict=True):
        s = labels.setdefault(r.features, [0.0, 0.0])
        s[0] += r.n * t
        s[1] += r.n
    codes = sorted(labels)
    b = classifier(codes, [labels[c][0] / labels[c][1] for c in codes], [labels[c][1] for c in codes])
    return [c for c, z in zip(codes, np.asarray(_design(codes) @ b).tolist(), strict=True) if z >= 0]


def found(docs: DataFrame, names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """One row per document row: doc_id, n_<kind> of the base kinds, base_sha256, spans, n_added."""
    rows = stored(candidates(docs, names), "pii-candidates")
    accepted = accepted_features(rows)
    take = F.filter("added", lambda c: c["features"].isin(accepted)) if accepted else F.slice("added", 1, 0)
    names = F.array(*[F.lit(k) for k in KINDS])

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)], "base_sha256", text_of(F.concat(F.col("base"), take)).alias("spans"), F.size(take).cast("long").alias("n_added"))
