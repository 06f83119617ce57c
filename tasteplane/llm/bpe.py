r"""BPE encoding by backtracking, decoding by an offset table.

The vocabulary's merges are public; nothing is trained. A word becomes a string over the
byte alphabet whose last character is moved to a plane of its own, which stands for the
end-of-word mark. An Aho-Corasick automaton over all tokens gives the longest token at every
position. The encoder walks forward with longest matches; a token is accepted if it is
compatible with the one before it, which means that merging by rank would not have joined
across their border. Compatibility follows from the merge table alone and is remembered per
pair. Otherwise the next shorter token is tried, and when none is left the encoder steps
back; a position found to be a dead end is not visited again, so the work is linear.

Decoding looks each id up in a table of offsets into one string of all tokens.

Words repeat, so a task remembers short encoded words in two generations of bounded size: a full
one takes the place of the older, from which words in use are taken over. It holds some
tens of MB, and a worker gives them back when the task ends. Nothing is dropped from the output.

Edge cases: null text is empty (no ids, digests of the empty string); special token strings
in a text are those tokens, as in the library; repeated rows are encoded each; an empty
table gives no rows; a null doc_id stays null; very long texts and runs without spaces are encoded whole,
in memory in proportion to their own length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.llm._shared import arrow_map

#: white space of the normaliser's \s: the Unicode property, without the separators U+001C to U+001F
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: words of a generation, pairs that are remembered, and the length up to which a word is (each entry stays under 1 KB)
REMEMBERED_WORDS, REMEMBERED_PAIRS, REMEMBERED_LENGTH = 150_000, 200_000, 48
_END = 0x10000  # added to a character to mark it as the last of a word


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the others follow from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Memory:
    """Answers to short strings, in two generations."""

    def __init__(self, answer) -> None:
        self.answer = answer
        self.new: dict = {}
        self.old: dict = {}

    def __call__(self, key: str):
        if (got := self.new.get(key)) is not None:
            return got
        if (got := self.old.get(key)) is None:
            got = self.answer(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self.new) >= REMEMBERED_WORDS:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got


class Encoder:
    def __init__(self, spec: str | dict) -> None:
        import ahocorasick
        import regex

        spec = json.loads(spec) if isinstance(spec, str) else spec
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split_re = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", SPACE))
        self._space_re = regex.compile(f"[{SPACE}]+")
        self._bytes = _byte_alphabet()

        self._offsets, self._blob = self._offset_table({**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}})

        def inner(token: str) -> str:
            return token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + _END) if token.endswith(suffix) and len(token) > len(suffix) else token

        # tokens are numbered anew: symbols first, then merges in order of rank
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        symbols = [t for t in vocab if t not in made]
        number = {inner(t): k for k, t in enumerate(symbols)}
        self._to_id = [vocab[t] for t in symbols]
        self._halves: list[tuple[int, int]] = [(k, k) for k in range(len(symbols))]
        self._merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = (number[inner(a)], number[inner(b)])
            if pair in self._merged or inner(a + b) in number:
                continue
            k = len(self._halves)
            number[inner(a + b)] = self._merged[pair] = k
            self._halves.append(pair)
            self._to_id.append(vocab[a + b])
        self._length = [0] * len(number)
        self._automaton = ahocorasick.Automaton()
        for token, k in number.items():
            self._automaton.add_word(token, k)
            self._length[k] = len(token)
        self._automaton.make_automaton()
        self._shorter = [-1] * len(number)
        for token, k in number.items():
            for n in range(len(token) - 1, 0, -1):
                if (p := number.get(token[:n])) is not None:
                    self._shorter[k] = p
                    break
        self._compatible: dict[int, bool] = {}
        self._chunks, self._words = Memory(self._chunk), Memory(self._word)

    def forget(self) -> None:
        """Give back the memory of words and pairs; the tables stay."""
        self._compatible, self._chunks, self._words = {}, Memory(self._chunk), Memory(self._word)

    @staticmethod
    def _offset_table(tokens: dict[int, str]) -> tuple[array, str]:
        offsets, at = array("Q", [0]), 0
        parts = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        for t in parts:
            at += len(t)
            offsets.append(at)
        return offsets, "".join(parts)

    def token(self, i: int) -> str:
        return self._blob[self._offsets[i] : self._offsets[i + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two tokens: no merge over it comes before those that hide it. The answer is remembered."""
        key = left << 32 | right
        bound = len(self._halves)
        ok = None
        while ok is None:
            over = self._merged.get((left, right))
            if over is not None and over < bound:
                ok = False
            elif left > right:  # the later of the two is taken apart
                bound, inner = left, self._halves[left][1]
                if inner == left:
                    bound, outer = right + 1, self._halves[right][0]
                    ok = True if outer == right else None
                    right = outer
                left = inner
            else:
                bound, inner = right + 1, self._halves[right][0]
                if inner == right:
                    bound, outer = left, self._halves[left][1]
                    ok = True if outer == left else None
                    left = outer
                right = inner
        if len(self._compatible) >= REMEMBERED_PAIRS:
            self._compatible.clear()
        self._compatible[key] = ok
        return ok

    def _backtrack(self, word: str) -> list[int]:
        longest = [-1] * (len(word) + 1)
        length = self._length
        for end, k in self._automaton.iter(word):  # by their ends, so of one start the longest comes last
            longest[end + 1 - length[k]] = k
        out: list[int] = []
        alive = bytearray(b"\x01") * (len(word) + 1)
        shorter, compatible = self._shorter, self._compatible.get
        at, candidate, last, end = 0, longest[0], -1, len(word)
        while at < end:
            while candidate >= 0:
                if alive[at + length[candidate]]:
                    if last < 0:
                        break
                    if (fits := compatible(last << 32 | candidate)) is None:
                        fits = self._fits(last, candidate)
                    if fits:
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at += length[candidate]
                last, candidate = candidate, longest[at]
            else:
                alive[at] = 0
                at -= length[last]
                candidate = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def word_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token (already normalised)."""
        mapped = piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join([self._bytes[b] for b in piece.encode("utf-8")])
        return [self._to_id[k] for k in self._backtrack(mapped[:-1] + chr(ord(mapped[-1]) + _END))]

    def _word(self, piece: str) -> tuple[str, int, str]:
        """Ids (joined), their number and the decoded text of one pre-token."""
        ids = self.word_ids(piece)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        """Ids (joined), their number and the decoded text of a run without white space."""
        low = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        low = "".join(map(str.lower, low)) if "Σ" in low else low.lower()  # sigma has no final form here
        pieces = [low] if low.isascii() and low.isalpha() else self._split_re.findall(low)
        if len(pieces) == 1:
            return self._words(pieces[0])
        got = [self._words(piece) for piece in pieces]
        return " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])

    def _pieces(self, text: str) -> list[tuple[str, int, str]]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = [c for c in self._space_re.split(text) if c]
        else:
            chunks = text.split()
        known, ask = self._chunks.new.get, self._chunks
        return [known(c) or ask(c) for c in chunks]

    def encode(self, text: str) -> tuple[str, int, str]:
        """(ids joined by spaces, number of ids, decoded text) of a whole text."""
        if self._special_re and any(s in text for s in self.special):
            got = []
            for part in self._special_re.split(text):
                got += [(str(self.special[part]), 1, part)] if part in self.special else self._pieces(part)
        else:
            got = self._pieces(text)
        got = [g for g in got if g[1]]
        return " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary names no decoder."""
        at, blob = self._offsets, self._blob
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def tokenized(docs: DataFrame, spec: str, with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; after them the columns ``keep`` of ``docs``.

    ``spec`` (a few MB at most) travels with the tasks.
    """
    import pyarrow as pa

    spread = docs.sparkSession.sparkContext.broadcast(spec)
    keep = keep or []
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spread.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            n, ids, decoded, lists = [], [], [], []
            for value in batch.column(1):
                joined, count, back = enc.encode(value.as_py() or "")
                n.append(count)
                ids.append(sha(joined))
                decoded.append(sha(back))
                if with_ids:
                    lists.append([int(x) for x in joined.split()])
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [*names, *keep])
        enc.forget()

    return arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep]), run, schema)
