"""BPE encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the result of byte-pair merging exactly if every pair of neighbours is
what merging makes of the two tokens' own text. The encoder therefore walks a word from the
left, takes the longest token that starts there (an Aho-Corasick automaton gives it), and falls back to the next shorter one, or one
token back, where the pair is not compatible. Places shown to be dead ends are remembered, so a
word takes time linear in its length.

Words recur, so results are kept for each piece of text between white space, in a table of
bounded size; no merge rule reaches across white space.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import regex

#: Ends a word inside the automaton; no mapped byte uses it.
END = "\n"
#: Letters of a word that the automaton reads at a time.
WINDOW = 512
#: str.split() takes these for white space, the tokenizer's pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Marks that follow a word as one token's text, and never begin a contraction.
MARKS = ".,;:!?%&*$#)\"|-"
SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the
    rest for the code points from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


class _Recent(dict):
    """Results by key, in two generations: when the younger is full, it becomes the older one. So
    memory is bounded, and what recurs stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends", read once for each Python worker."""

    def __init__(self, path: str, cached: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        names = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            names[i] = s
        # the offset table: token i is blob[offsets[i]:offsets[i + 1]]
        coded = [s.encode() for s in names]
        self.blob = b"".join(coded)
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).tolist()

        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        inner = {(s.removesuffix(suffix) + END if s.endswith(suffix) and len(s) > len(suffix) else s): i for s, i in vocab.items()}
        self.inner = inner
        self.length = [0] * size
        self.shorter = [-1] * size
        automaton = ahocorasick.Automaton()
        for s, i in inner.items():
            self.length[i] = len(s)
            automaton.add_word(s, i)
            for n in range(len(s) - 1, 0, -1):
                if (p := inner.get(s[:n])) is not None:
                    self.shorter[i] = p
                    break
        automaton.make_automaton()
        self.widest = max(self.length)
        self.automaton = automaton
        # what merging two tokens makes, each token's two parts, and when it is made (0: a letter)
        self.made: dict[int, int] = {}
        self.order = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[x + y]
            self.made[vocab[x] << 20 | vocab[y]] = token
            self.order[token], self.left[token], self.right[token] = rank + 1, vocab[x], vocab[y]
        # tokens that merging makes of their own text; the parts of a token come before it
        self.whole = [False] * size
        for token in sorted(vocab.values(), key=self.order.__getitem__):
            x, y, n = self.left[token], self.right[token], self.order[token]
            self.whole[token] = n == 0 or self.whole[x] and self.whole[y] and self.apart(x, y, n)
        #: by the token before (none: the last row) and a token: the longest of it and its prefixes that may follow
        self.rows: list[dict[int, int]] = [{-1: -1} for _ in range(size + 1)]
        self.chunks = _Recent(self._chunk, cached)

    def apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge joins a and b, or parts of them that meet, before step ``limit``.

        The merges are undone from the last one on; at each state the two tokens that meet must
        not be merged earlier than the step that has taken one of them away.
        """
        made, order = self.made, self.order
        while True:
            token = made.get(a << 20 | b)
            if token is not None and order[token] < limit:
                return False
            if order[a] > order[b]:
                limit, a = order[a], self.right[a]
            elif order[b]:
                # equal steps go from left to right, so the same step may still take b's letters
                limit, b = order[b] + 1, self.left[b]
            else:
                return True

    def fitting(self, before: int, token: int) -> int:
        """The longest of a token and its prefixes that merging leaves as it is after ``before``; -1 if none."""
        row, whole, shorter, found = self.rows[before], self.whole, self.shorter, token
        while found >= 0 and not (whole[found] and (before < 0 or self.apart(before, found, 1 << 30))):
            found = shorter[found]
        if len(row) > 5000:
            row.clear()
            row[-1] = -1
        row[token] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word that the pre-tokenizer has cut, in mapped letters without the word end."""
        ended = word + END
        token = self.inner.get(ended)
        if token is not None and self.whole[token]:
            return [token]
        n, length, shorter, rows, matches = len(ended), self.length, self.shorter, self.rows, self.automaton.iter_long
        last = n - 1  # a token without the word end can't hold the last letter
        out: list[int] = []
        at, before, row, dead = 0, -1, rows[-1], set()
        # every letter is a token, so a match begins where the one before has ended; a window of the word is matched at a time
        longest, limit = matches(ended if n <= WINDOW else ended[:WINDOW]), WINDOW - self.widest
        base, (reached, token) = 0, next(longest)
        while True:
            found = row.get(token)
            token = self.fitting(before, token) if found is None else found
            if token >= 0:
                end = at + length[token]
                if end == n:
                    out.append(token)
                    return out
                if end == last or end in dead:
                    token = shorter[token]
                    continue
                out.append(token)
                before, at, row = token, end, rows[token]
                if reached != end - 1 or end - base > limit:  # not the longest token was taken, or the window ends
                    longest, base = matches(ended[at : at + WINDOW]), at
                reached, token = next(longest)
                reached += base
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
                row, token = rows[before], shorter[token]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text, as little-endian unsigned 32-bit numbers."""
        if chunk.isascii():
            s = chunk.lower()
            core = s.rstrip(MARKS)
            if core.isalpha():  # a word, or a word and marks
                if len(core) < len(s):
                    return self.chunks[core] + self.chunks[s[len(core) :]]
                return array("I", self.encode_word(s)).tobytes() if s == chunk else self.chunks[s]
            if s.isprintable():
                return b"".join([array("I", self.encode_word(word)).tobytes() for word in self.pattern.findall(s)])
        else:
            s = unicodedata.normalize("NFC", chunk)
            s = s.replace("Σ", "σ").lower()  # letter by letter: no final sigma
            core = s.rstrip(MARKS)
            if core.isalpha():
                ids = array("I", self.encode_word(self._mapped(core))).tobytes() if core == chunk else self.chunks[core]
                return ids + self.chunks[s[len(core) :]] if len(core) < len(s) else ids
        return b"".join([array("I", self.encode_word(self._mapped(word))).tobytes() for word in self.pattern.findall(s)])

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit numbers."""
        if self.specials is not None and "<|" in text:
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pieces = filter(None, SPACE.split(text)) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        """The tokens' texts joined by one space, in UTF-8: this tokenizer has no decoder of its own."""
        blob, at = self.blob, self.offsets
        return b" ".join([blob[at[i] : at[i + 1]] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode()


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file; a Python worker reads it once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_each(docs, derive, schema: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Encode every whole text and keep what derive(id, ids as bytes, tokenizer) returns for it.

    derive gives a list of rows that fit the schema. A null text counts as empty; a null id is
    kept as null; rows that repeat are encoded each; further columns are not read. One Arrow
    batch of texts is in memory at a time. path: the tokenizer file, on each executor; by
    default the public one.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from talkweave.llm.common import ship, tokenizer_path

    ship(docs.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def packed(rows):
            columns = zip(*rows) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        coder = loaded(path or tokenizer_path())
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += derive(key, coder.encode_bytes(text.as_py() or ""), coder)
                if len(rows) >= 5000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def encode(docs, **options):
    """One row per document: its id, its token ids and the decoded text."""
    return encode_each(docs, lambda key, ids, coder: [(key, (i := np.frombuffer(ids, "<u4").tolist()), coder.decode(i))], "doc_id long, ids array<int>, decoded string", **options)


def digests(docs, **options):
    """One row per document: how many tokens it has, and the SHA-256 of its ids and of the decoded text."""

    def derive(key, ids, coder):
        from hashlib import sha256

        numbers = np.frombuffer(ids, "<u4").tolist()
        return [(key, len(numbers), sha256(" ".join(map(str, numbers)).encode()).hexdigest(), sha256(coder.decode_bytes(numbers)).hexdigest())]

    return encode_each(docs, derive, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)
