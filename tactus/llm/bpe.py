"""BPE encoding and decoding by depth-first traversal of a word trie.

The encoding of a word is found from its prefixes: the last token of the
encoding of a prefix ending at i is the only vocabulary token t that ends
there and may follow the last token of the prefix that t leaves (a pair may
follow each other exactly when merging their joined symbols gives the pair
back). The distinct words of a batch form a trie; it is walked depth first (in
sorted order of the words, where each word shares the walked path down to its
longest common prefix with the word before), the last-token state is handed
down from node to node, and so the states of shared prefixes are computed
once. The final letter of a word is its own edge, since it carries the
end-of-word mark.

Texts are divided, as the tokenizer file prescribes, into special tokens,
normalised (NFC, white space, lower case) and split into words. Every step is
narrow: no shuffle, and memory is bounded by the batch as it arrives, by the
words and results of PART bytes of its texts, and by CACHE entries.

Defined cases: a null text counts as empty and has no tokens; other columns
are untouched, and a document column named like a result column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tactus.llm.common import as_bytes

#: Entries of each of a worker's caches (divided words, pairs); a full cache is emptied.
CACHE = 150_000
#: Bytes of text that are divided into words at once; a longer text is a part of its own.
PART = 1 << 22
#: With forget, caches and parts are smaller by this factor.
LEAN = 3


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(more)
            more += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A BPE model with end-of-word marks, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = (p if isinstance(p, list) else p.split(" ") for p in model["merges"])
        size = max(self.tokens) + 1
        #: The merge that makes a token: its rank (-1: a plain symbol), its left and right part.
        self.order, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, merged = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = r
            self.order[merged], self.left[merged], self.right[merged] = r, x, y
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.word = regex.compile(pattern.replace(r"[^\s", f"[^{space}"))
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.id_text = {t: str(t).encode() for t in self.tokens}
        self.token_text = {t: x.encode() for t, x in self.tokens.items()}
        self.letters = dict(enumerate(_byte_letters()))
        self.follows: list[dict[int, bool]] = [{} for _ in range(size)]
        self.known_pairs = 0
        self.spelled: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.lean = 1

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b, side by side, gives a and b.

        Goes back in time: the later made of the two is taken apart, and the
        pair that then met at the seam must not have merged before that.
        """
        order, limit = self.order, len(self.rank) + 1
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            if order[a] > order[b]:
                limit, a = order[a], self.right[a]
            elif order[b] >= 0:  # of equal pairs the left one merges first
                limit, b = order[b] + 1, self.left[b]
            else:
                return True

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words, given in the vocabulary's letters."""
        out: dict[str, list[int]] = {}
        get, follows, longest, mark = self.ids.get, self.follows, self.longest, self.end
        before, last, start = "", [0], [0]
        for word in sorted(words):
            n, depth = len(word), 0
            most = min(n, len(before)) - 1
            while depth < most and word[depth] == before[depth]:
                depth += 1
            if len(last) <= n:
                last.extend([0] * (n + 1 - len(last)))
                start.extend([0] * (n + 1 - len(start)))
            for i in range(depth + 1, n + 1):
                end = mark if i == n else ""
                for j in range(i - 1, max(0, i - longest) - 1, -1):
                    token = get(word[j:i] + end)
                    if token is None:
                        continue
                    if j == 0:
                        break
                    known, tail = follows[token], last[j]
                    fits = known.get(tail)
                    if fits is None:
                        fits = known[tail] = self.may_follow(tail, token)
                        self.known_pairs += 1
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}")
                last[i], start[i] = token, j
            ids, i = [], n
            while i:
                ids.append(last[i])
                i = start[i]
            ids.reverse()
            out[word] = ids
            before = word
        if self.known_pairs > 4 * CACHE // self.lean:
            self.follows = [{} for _ in self.follows]
            self.known_pairs = 0
        return out

    def normal(self, text: str) -> str:
        """As the tokenizer does, letter by letter: a final sigma is not looked for."""
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def words(self, text: str) -> list[str | int]:
        """Words of a text, and ids of special tokens."""
        out: list[str | int] = []
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            out += [self.special[part]] if k % 2 else self.word.findall(self.normal(part))
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks of text (without ASCII white space) into the cache."""
        texts = b"\n".join(chunks).decode().split("\n")
        normal = self.normal("\n".join(texts)).split("\n")
        divided: list[list[str | int]] = []
        for text, plain in zip(texts, normal, strict=True):
            if plain.isalpha():
                divided.append([plain])
            elif (head := plain[:-1]).isalpha() and plain[-1:] in ".,;:!?|":
                divided.append([head, plain[-1]])
            else:
                divided.append(self.words(text))
        spelled = self.spelled
        new = {w for words in divided for w in words if isinstance(w, str)} - spelled.keys()
        if len(spelled) + len(new) > 2 * CACHE // self.lean:
            spelled.clear()
            new = {w for words in divided for w in words if isinstance(w, str)}
        coded = {w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in new}
        ids = self.encode_words(set(coded.values()))
        id_text, token_text = self.id_text, self.token_text
        for word, letters in coded.items():
            own = ids[letters]
            spelled[word] = b" ".join([id_text[t] for t in own]), b" ".join([token_text[t] for t in own])
        pieces = self.pieces
        for chunk, words in zip(chunks, divided, strict=True):
            if len(words) == 1 and words[0] in spelled:
                pieces[chunk] = spelled[words[0]]
            else:
                parts = [spelled[w] if isinstance(w, str) else (id_text[w], token_text[w]) for w in words]
                pieces[chunk] = b" ".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def encode_batch(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """(ids joined by spaces, decoded text) of each text."""
        divided = [t.split() if t else [] for t in texts]
        pieces = self.pieces
        new = set().union(*divided) - pieces.keys()
        if new:
            if len(pieces) + len(new) > 3 * CACHE // self.lean:
                pieces.clear()
                new = set().union(*divided)
            self.learn(list(new))
        out = []
        for chunks in divided:
            found = [pieces[c] for c in chunks]
            out.append((b" ".join([f[0] for f in found if f[0]]), b" ".join([f[1] for f in found if f[1]])))
        return out

    def encode_column(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """encode_batch of a column of texts, with the words of one part at a time."""
        for first, n in parts(column, PART // self.lean):
            yield from self.encode_batch(as_bytes(column.slice(first, n)))

    def forget(self) -> None:
        """Empties the caches."""
        self.spelled, self.pieces, self.known_pairs = {}, {}, 0
        self.follows = [{} for _ in self.follows]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, n) of runs of texts of most bytes together, or of one text."""
    first, held = 0, 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if k > first and held + size > most:
            yield first, k - first
            first, held = k, 0
        held += size
    if len(column) > first:
        yield first, len(column) - first


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The model of a tokenizer file, read once in a process."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", digests: bool = False, forget: bool = False) -> DataFrame:
    """docs with ``n_tokens`` and, either ``ids`` (array<int>) and ``decoded``, or their SHA-256 digests.

    path is the tokenizer file's place on every machine (a path of an
    installed package); it is never copied. With forget, the caches last as
    long as a task and are smaller: less memory beside other steps, more time.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens bigint, ids array<int>, decoded string"
    names = [c for c in docs.columns if c not in results]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), kinds])
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in names]

    def batches(it):
        bpe = model(path)
        bpe.lean = LEAN if forget else 1
        try:
            yield from encoded(bpe, it)
        finally:
            if forget:
                bpe.forget()

    def encoded(bpe, it):
        for batch in it:
            n, a, b = [], [], []
            for ids, decoded in bpe.encode_column(batch.column(at)):
                n.append(ids.count(b" ") + 1 if ids else 0)
                if digests:
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(decoded).hexdigest())
                else:
                    a.append([int(i) for i in ids.split()])
                    b.append(decoded.decode())
            columns = [pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], [*names, *results])

    return docs.mapInArrow(batches, schema)
