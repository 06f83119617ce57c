r"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary. Each language has a probability for every
piece; a word (letters only, lower-cased, with a start mark) has the sum over all its
segmentations into pieces, computed by the forward algorithm, and a text the product over its words.

Piece probabilities are estimated by expectation-maximisation over the words of a bounded
sample of labelled documents (at most about SAMPLE_DOCS of each of the MOST_LANGUAGES most frequent labels,
drawn by a hash of doc_id): the sample's words are counted per language in Spark, the counts (bounded by the
sample) go to the driver, and expected piece counts come from forward and backward sums over
all words at once. Letters that no piece covers cost the same in every language.

The score is the posterior among the learned languages, which soon is 1 for any long text. So a
text of none of them is told by another figure, its strangeness: its mean negative log
likelihood a letter in the predicted language, over that of the language's own training words (1 is
typical), less 8 over the number of words, for short texts vary more.

Words repeat, so a task remembers scored words in two generations of bounded size: a full one takes
the place of the older, from which words in use are taken over. Whole texts are scored, some words at a time.

Edge cases: null text, and text without letters (number signs such as a half or a Roman numeral
sign are none), gives ``und`` with score 0; so does every
text when nothing was learned (no labelled training rows); strangeness is null then. Runs of letters are cut into
segments of at most 32. Ties between languages go to the first name. Repeated rows get equal
rows; an empty table gives no rows; very long texts are scored whole, in bounded memory; all columns of the
input can be kept, whatever their names (``identified`` tells those of the columns that it adds).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import arrow_map, unused

SAMPLE_DOCS, MOST_LANGUAGES, ROUNDS, LONGEST = 1_000, 1_000, 4, 32
UNKNOWN, SMOOTHING = 1e-8, 0.01
#: remembered words of a generation, words of one lattice, and characters that are cut into words at once
_REMEMBERED_WORDS, _LATTICE_WORDS, _PART = 75_000, 8_000, 200_000
_MARK = "▁"


#: letters, and number signs (a half, a circled one), which re has no class without
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: the number signs alone: what remains has runs of letters as words
_SIGN = re.compile("[" + "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")


#: those among the first 256 characters, which most texts do not leave
_FEW_SIGNS = [c for c in map(chr, range(0x80, 0x100)) if _SIGN.match(c)]


def lowered(text: str | None) -> str:
    """Lower-case, with spaces in place of number signs."""
    low = (text or "").lower()
    if low.isascii():
        return low
    try:
        low.encode("latin-1")  # quicker than a search for all signs
    except UnicodeEncodeError:
        return _SIGN.sub(" ", low)
    for sign in _FEW_SIGNS:
        if sign in low:
            low = low.replace(sign, " ")
    return low


def pieces_of(model_file: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-case, with or without the word-start mark."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    return sorted({n for n in names if n == n.lower() and (n == _MARK or n.removeprefix(_MARK).isalpha())})


#: cells of a trie's table (4 bytes each); a larger one is looked up in a sorted list of its steps
_CELLS = 1 << 24


class Trie:
    """Every beginning of a piece as a state, stepped through for many places at once. State 0 is no beginning; up to ``inner`` pieces go on."""

    def __init__(self, number: dict[str, int]) -> None:
        import numpy as np

        states = {p: s for s, p in enumerate(sorted({p[:i] for p in number for i in range(1, len(p))}), 1)}
        self.inner = len(states)
        for p in sorted(number):
            states.setdefault(p, len(states) + 1)
        self.piece = np.full(len(states) + 1, -1, np.int32)
        self.piece[[states[p] for p in number]] = list(number.values())
        # letters by number, those behind the first place before the others; 0 is none of them
        behind = sorted({c for p in number for c in p[1:]})
        letters = {c: k for k, c in enumerate(behind + sorted({p[0] for p in number} - set(behind)), 1)}
        self.width = len(behind) + 1
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.first = np.zeros(len(letters) + 1, np.int32)
        steps = []
        for p, s in states.items():
            if len(p) == 1:
                self.first[letters[p]] = s
            else:
                steps.append((states[p[:-1]] * self.width + letters[p[-1]], s))
        keys, values = np.array(sorted(steps), np.int64).reshape(-1, 2).T
        if (self.inner + 1) * self.width <= _CELLS:
            self.table = np.zeros((self.inner + 1) * self.width, np.int32)
            self.table[keys] = values
        else:
            self.table, self.keys, self.values = None, np.append(keys, -1), np.append(values, 0).astype(np.int32)

    def letters(self, codes):
        import numpy as np

        return self.letter[np.minimum(codes, len(self.letter) - 1)]

    def step(self, state, letter):
        import numpy as np

        key = state.astype(np.int64) * self.width + np.where(letter < self.width, letter, 0)
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.values[at], 0)


class Lattice:
    """All pieces at all places of a list of words."""

    def __init__(self, words: list[str], number: dict[str, int], trie: Trie | None = None) -> None:
        import numpy as np

        trie = trie or Trie(number)
        self.n = len(words)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        # the words one behind the other, with a place of no letter after each
        letter = trie.letters(np.frombuffer("".join(f"{_MARK}{w}\n" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32))
        word = np.repeat(np.arange(self.n), self.length + 1)
        begins = np.cumsum(self.length + 1) - self.length - 1
        inside = np.ones(len(letter), bool)
        inside[begins + self.length] = False
        letter[~inside] = 0
        # a piece at a place is one number: end, word, start (six bits each, words being short) and piece
        unknown, bits = len(number), (len(number) + 1).bit_length()
        one_end = 1 << (self.n.bit_length() + 6 + bits)
        start = np.arange(len(letter)) - begins[word]
        place = start * one_end + ((word << 6 | start) << bits)
        at = np.flatnonzero(inside)
        state = trie.first[letter[at]]
        piece = trie.piece[state]
        found, n = [place[at] + one_end + np.where(piece < 0, unknown, piece)], 1
        while len(at):
            on = np.flatnonzero((state > 0) & (state <= trie.inner))
            at = at[on]
            state = trie.step(state[on], letter[at + n])
            n += 1
            piece = trie.piece[state]
            hit = np.flatnonzero(piece >= 0)
            found.append(place[at[hit]] + n * one_end + piece[hit])
        code = np.sort(np.concatenate(found))
        self.end = (code // one_end).astype(np.int16)
        self.piece = (code & ((1 << bits) - 1)).astype(np.int32)
        self.start = ((code >> bits) & 63).astype(np.int16)
        self.word = ((code & (one_end - 1)) >> (bits + 6)).astype(np.int32)
        top = int(self.end[-1]) if len(self.end) else 0
        self.cuts = np.searchsorted(self.end, np.arange(1, top + 2))

    def forward(self, p):
        """alpha[position, word]: the sum over segmentations of each word's beginning."""
        import numpy as np

        alpha = np.zeros((len(self.cuts), self.n))
        alpha[0] = 1
        for e in range(1, len(self.cuts)):
            s = slice(self.cuts[e - 1], self.cuts[e])
            alpha[e] = np.bincount(self.word[s], alpha[self.start[s], self.word[s]] * p[self.piece[s]], self.n)
        return alpha

    def totals(self, p):
        import numpy as np

        return self.forward(p)[self.length, np.arange(self.n)]

    def expected(self, p, counts):
        """Expected number of uses of each piece over words that occur ``counts`` times."""
        import numpy as np

        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.length, np.arange(self.n)] = 1
        for e in range(len(self.cuts) - 1, 0, -1):  # pieces that end at e add to where they start
            s = slice(self.cuts[e - 1], self.cuts[e])
            np.add.at(beta, (self.start[s], self.word[s]), beta[e, self.word[s]] * p[self.piece[s]])
        total = alpha[self.length, np.arange(self.n)]
        weight = np.divide(counts, total, out=np.zeros(self.n), where=total > 0)
        use = alpha[self.start, self.word] * p[self.piece] * beta[self.end, self.word] * weight[self.word]
        return np.bincount(self.piece, use, len(p))


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    #: one row a language, one column a piece; the last column is an unknown letter
    probability: object
    #: mean negative log likelihood a letter of each language's training words
    typical: list[float]


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """EM from word counts of each language."""
    import numpy as np

    number = {p: k for k, p in enumerate(pieces)}
    trie = Trie(number)
    rows, typical = [], []
    for lang in sorted(counts):
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], float)
        p = np.full(len(pieces) + 1, 1 / max(1, len(pieces)))
        p[-1] = UNKNOWN
        lattice = Lattice(words, number, trie)
        for _ in range(rounds):
            used = lattice.expected(p, n)[:-1] + SMOOTHING
            p[:-1] = used / used.sum()
        rows.append(p)
        letters = (n * lattice.length).sum()
        typical.append(float(-(n * np.log(np.maximum(lattice.totals(p), 1e-300))).sum() / letters) if letters else 1.0)
    return Model(sorted(counts), pieces, np.array(rows), typical)


def train(labelled: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> Model:
    """From rows with doc_id, text and lang. About ``sample_docs`` rows of each language are used, by a hash of doc_id."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    span = 1 << 30
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    shares = [(r.lang, int(span * min(1.0, sample_docs / r.n))) for r in sizes.collect()]
    if not shares:
        return Model([], pieces, None, [])
    limits = labelled.sparkSession.createDataFrame(shares, "lang string, limit long")
    # one row a language, MOST_LANGUAGES at most
    sample = labelled.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(span)) < F.col("limit"))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,%d}" % LONGEST), F.lit(0)))
    counts: dict[str, dict[str, int]] = {lang: {} for lang, _ in shares}
    for r in sample.select("lang", word.alias("word")).groupBy("lang", "word").count().toLocalIterator():
        counts[r.lang][r.word] = r["count"]
    return fit(counts, pieces)


class Scorer:
    def __init__(self, model: Model) -> None:
        import numpy as np

        self.model = model
        self.number = {p: k for k, p in enumerate(model.pieces)}
        self.trie = Trie(self.number)
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))
        self.filled = 0
        self.old: tuple = ({}, self.logs)

    def learn(self, words: set[str]) -> None:
        import numpy as np

        missing = [w for w in words if w not in self.index]
        if len(self.index) + len(missing) > _REMEMBERED_WORDS:
            self.old = self.index, self.logs
            self.index, self.logs, self.filled = {}, np.zeros((0, self.logs.shape[1])), 0
            missing = list(words)
        index, logs = self.old
        held = [w for w in missing if w in index]
        self._put(held, logs[[index[w] for w in held]])
        new = sorted(w for w in missing if w not in index)
        for at in range(0, len(new), _LATTICE_WORDS):
            some = new[at : at + _LATTICE_WORDS]
            lattice = Lattice(some, self.number, self.trie)
            self._put(some, np.stack([np.log(np.maximum(lattice.totals(p), 1e-300)) for p in self.model.probability], axis=1))

    def _put(self, words: list[str], logs) -> None:
        import numpy as np

        end = self.filled + len(words)
        if end > len(self.logs):
            self.logs = np.concatenate([self.logs[: self.filled], np.zeros((max(len(words), 25_000), logs.shape[1]))])
        self.logs[self.filled : end] = logs
        self.index.update(zip(words, range(self.filled, end), strict=True))
        self.filled = end

    def _summed(self, words: list[str]):
        import numpy as np

        return self.logs[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """Language, score and strangeness of each text."""
        import numpy as np

        if not self.model.languages:
            return [("und", 0.0, None)] * len(texts)
        sums: list = [None] * len(texts)
        sizes = np.zeros((len(texts), 2), np.int64)  # words and letters, with a word's mark as one

        def settle(held: list[tuple[int, list[str]]]) -> None:
            self.learn({w for _, words in held for w in words})
            for i, words in held:
                if words:
                    s = self._summed(words)
                    sums[i] = s if sums[i] is None else sums[i] + s
                    sizes[i] += len(words), len(words) + sum(map(len, words))

        held, size = [], 0
        for i, text in enumerate(texts):
            low, at = lowered(text), 0
            while at < len(low):  # parts end between words
                end = min(at + _PART, len(low))
                while end < len(low) and _WORD.match(low, end - 1):
                    end += 1
                held.append((i, _WORD.findall(low, at, end)))
                size += end - at
                at = end
                if size >= _PART:
                    settle(held)
                    held, size = [], 0
        settle(held)
        out: list[tuple[str, float, float | None]] = []
        for logs, (words, letters) in zip(sums, sizes.tolist(), strict=True):
            if logs is None:
                out.append(("und", 0.0, None))
            else:
                best = int(logs.argmax())
                strange = -float(logs[best]) / letters / self.model.typical[best] - 8 / words
                out.append((self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum()), strange))
        return out


def identified(docs: DataFrame, model: Model, keep: list[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """The columns ``keep`` (all by default) with prediction, score and strangeness after them, in one pass without a shuffle; the names of these three follow."""
    import pyarrow as pa

    spread = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    names = [unused(c, docs) for c in ("_lang_pred", "_score", "_strange")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")
    at = docs.columns.index("text")
    places = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(spread.value)
            got = []
            for i in range(0, batch.num_rows, 500):
                got += scorer.predict([v.as_py() for v in batch.column(at).slice(i, 500)])
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.string()), *[pa.array([g[k] for g in got], pa.float64()) for k in (1, 2)]], [*keep, *names])

    return arrow_map(docs, run, schema), *names
