"""BPE encoding and decoding by dynamic programming over prefixes.

A text is cut into words as the tokenizer file says. For every prefix of a word the
last token of its encoding is unique: it is the one vocabulary token that ends there
(an automaton's state knows every token that is a suffix of what was read) and that
stays apart from the last token of the prefix before it (the pair test). Following the
stored tokens back from the end gives the exact ids, in time linear in the word. Words
are encoded many at a time: a step takes the prefixes of one length of all words.

Results for special cases: null and empty texts have no tokens; equal rows have equal
results; the special strings of the vocabulary are single ids; further columns of the
input are neither read nor returned; a text of any length is processed whole; a null
doc_id is passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from driftloom.llm.common import KEPT, over_texts, texts_of

# Unicode white space, and how the tokenizer file cuts words.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: str.split() also cuts at these four, which are no white space here.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Words kept in each of two generations, and pairs; fewer take less memory, more CPU.
CACHED_CHARS, CACHE_WORDS, CACHE_PAIRS = 40, 120_000, 500_000
#: Texts are taken together up to so many characters (or one text, if it is longer).
TOGETHER_CHARS = 1 << 20
#: Words of more bytes are encoded alone; of the others, so many in one step at most.
LONG_WORD, WORDS_TOGETHER = 64, 1 << 15
#: Letters before this one are the same in all versions of Unicode.
OLD_LETTERS, ENDS = "\u0250", frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class NumberMap:
    """Whole numbers to whole numbers, looked up and stored by arrays: a hash table with
    open places, at most a quarter full."""

    def __init__(self, most: int):
        self.bits = (4 * most).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.n, self.most = 0, most

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        at = self._places(keys)
        there = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            out[open_] = self.values[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return np.where(self.keys[at] == keys, out, -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Stores distinct keys that aren't there yet."""
        at, self.n = self._places(keys), self.n + len(keys)
        while len(keys):
            places, first = np.unique(at, return_index=True)
            first = first[self.keys[places] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends.

    Inside, a word is a string over 512 symbols: chr(b) for byte b, and chr(256 + b) for
    a byte that ends the word. Symbols are tokens 0-511 and the k-th merge makes token
    512 + k, so that a smaller number always means an earlier merge.
    """

    def __init__(self, content: str, cache_words: int = CACHE_WORDS, together: int = TOGETHER_CHARS):
        self.cache_words, self.together = cache_words, together
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        number = {x: b for b, x in enumerate(letters)} | {x + suffix: 256 + b for b, x in enumerate(letters)}
        names = [*letters, *(x + suffix for x in letters)]
        self.spelling = [chr(k) for k in range(512)]
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(512)]
        self.merged: dict[int, int] = {}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in merges):
            a, b = number[left], number[right]
            token = len(self.parts)
            self.merged[a << 20 | b] = token
            self.parts.append((a, b))
            self.spelling.append(self.spelling[a] + self.spelling[b])
            names.append(left.removesuffix(suffix) + right)
            number[names[-1]] = token
        self.ids = np.array([vocab[n] for n in names], dtype="<u4")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: list[str] = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for name, k in [*vocab.items(), *self.special.items()]:
            self.names[k] = name
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word = regex.compile(WORD)
        self.space = regex.compile(f"[{SPACE}]+")
        # two generations: a full one becomes the older, whose words come back when met
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.id_bytes = [x.tobytes() for x in self.ids]
        self.sizes = list(map(len, self.spelling))
        self.decoded = [name.encode() for name in self.names]
        self.decoded_chars = np.array(list(map(len, self.names)))
        self._make_automaton()
        # the same as arrays
        self.step_to, self.merges, self.pairs = (NumberMap(len(x)) for x in (self.step, self.merged, range(CACHE_PAIRS)))
        for into, source in ((self.step_to, self.step), (self.merges, self.merged)):
            into.put(np.fromiter(source, np.int64, len(source)), np.fromiter(source.values(), np.int64, len(source)))
        self.shorter_of, self.size_of = np.array(self.shorter), np.array(self.sizes)
        self.ending_at = np.cumsum([0, *map(len, self.ending)])
        self.endings = np.array([t for tokens in self.ending for t in tokens])
        self.first_part, self.last_part = np.array(self.parts).T.copy()

    def _make_automaton(self) -> None:
        """States are the beginnings of tokens; ``step`` leads from state << 9 | symbol to
        the next, ``shorter`` to the longest other state that ends alike, and ``ending``
        lists the tokens that end in a state, the longest first."""
        self.step: dict[int, int] = {}
        own: list[int] = [-1]
        level: list[tuple[int, int, int]] = []
        for token, spelled in enumerate(self.spelling):
            # a token that its own spelling doesn't merge into can't occur in an encoding
            if token < 512 or self._stay_apart_until(*self.parts[token], token):
                state = 0
                for depth, symbol in enumerate(map(ord, spelled)):
                    below = self.step.get(state << 9 | symbol)
                    if below is None:
                        below = self.step[state << 9 | symbol] = len(own)
                        own.append(-1)
                        level.append((depth, state << 9 | symbol, below))
                    state = below
                own[state] = token
        self.shorter = [0] * len(own)
        self.ending: list[tuple[int, ...]] = [()] * len(own)
        for depth, key, state in sorted(level):
            if depth:
                at, symbol = self.shorter[key >> 9], key & 511
                while (found := self.step.get(at << 9 | symbol)) is None and at:
                    at = self.shorter[at]
                self.shorter[state] = found or 0
            rest = self.ending[self.shorter[state]]
            self.ending[state] = (own[state], *rest) if own[state] >= 0 else rest

    def _stay_apart_until(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge earlier than ``limit`` joins symbols of left and right.

        Undoes the later of the two tokens step by step; at each moment of the merging
        the two tokens that touch must not be a pair that merges sooner than the token
        which was undone last was made.
        """
        while True:
            joined = self.merged.get(left << 20 | right)
            if joined is not None and joined < limit:
                return False
            if left < 512 and right < 512:
                return True
            if left > right:
                limit, left = left, self.parts[left][1]
            else:
                # of two equal tokens the right one is made later, so a pair that
                # merges with this very number still comes first
                limit, right = right + 1, self.parts[right][0]

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pairs of tokens can follow each other, by arrays: 1 or 0."""
        keys = left << 20 | right
        known = self.pairs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            fits = self._tested(new >> 20, new & (1 << 20) - 1)
            known[known < 0] = fits[np.searchsorted(new, keys[known < 0])]
            if self.pairs.n + len(new) > CACHE_PAIRS:
                self.pairs = NumberMap(CACHE_PAIRS)
            if len(new) <= CACHE_PAIRS:
                self.pairs.put(new, fits)
        return known

    def _tested(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What :meth:`_stay_apart_until` says of each pair, without a limit."""
        fits, open_, limit = np.ones(len(left), np.int32), np.arange(len(left)), np.full(len(left), 1 << 30)
        while len(open_):
            joined = self.merges.get(left << 20 | right)
            merge = (joined >= 0) & (joined < limit)
            fits[open_[merge]] = 0
            on = ~merge & ((left >= 512) | (right >= 512))
            open_, left, right = open_[on], left[on], right[on]
            later = left > right
            limit = np.where(later, left, right + 1)
            left, right = np.where(later, self.last_part[left], left), np.where(later, right, self.first_part[right])
        return fits

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of non-empty words, given in UTF-8 letters."""
        raws = sorted(((w.encode("utf-8", "surrogatepass"), w) for w in words), key=lambda x: -len(x[0]))
        long = sum(len(raw) > LONG_WORD for raw, _ in raws)
        found = {w: self._encode_long(raw) for raw, w in raws[:long]}
        raws = raws[long:]
        for at in range(0, len(raws), WORDS_TOGETHER):
            some = raws[at : at + WORDS_TOGETHER]
            ids, edges = self._encode_short([raw for raw, _ in some])
            found |= {w: ids[a:b] for (_, w), a, b in zip(some, edges[:-1], edges[1:], strict=True)}
        return found

    def _encode_short(self, raws: list[bytes]) -> tuple[bytes, list[int]]:
        """Ids of words, the longest first, one after the other, and where each starts."""
        lengths = np.array(list(map(len, raws)))
        starts = np.cumsum(lengths) - lengths
        symbols = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        symbols[starts + lengths - 1] += 256
        state, last = np.zeros(len(raws), np.int64), np.zeros((len(raws), int(lengths[0]) + 1), np.int32)
        for done in range(1, int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -done, "right"))  # words as long as this
            state, symbol = state[:n], symbols[starts[:n] + done - 1]
            below = self.step_to.get(state << 9 | symbol).astype(np.int64)
            miss = np.flatnonzero(below < 0)
            while len(miss):
                state[miss] = self.shorter_of[state[miss]]
                below[miss] = self.step_to.get(state[miss] << 9 | symbol[miss])
                miss = miss[below[miss] < 0]
            state, open_, at = below, np.arange(n), self.ending_at[below]
            while len(open_):  # each prefix has its one last token; the longest are tried first
                token = self.endings[at]
                size = self.size_of[token]
                fits = size == done
                part = np.flatnonzero(~fits)
                fits[part] = self.stay_apart(last[open_[part], done - size[part]].astype(np.int64), token[part]) > 0
                last[open_[fits], done] = token[fits]
                open_, at = open_[~fits], at[~fits] + 1
        word, place = np.arange(len(raws)), lengths.copy()
        backwards: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            token = last[word, place[word]]
            backwards.append((word, token))
            place[word] -= self.size_of[token]
            word = word[place[word] > 0]
        counts = np.zeros(len(raws), np.int64)
        for word, _ in backwards:
            counts[word] += 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), "<u4")
        for k, (word, token) in enumerate(backwards, 1):
            out[ends[word] - k] = self.ids[token]
        return out.tobytes(), [0, *(4 * ends).tolist()]

    def _encode_long(self, raw: bytes) -> bytes:
        step, shorter, ending, sizes = self.step, self.shorter, self.ending, self.sizes
        state, last = 0, [0]
        for done, symbol in enumerate((*raw[:-1], 256 + raw[-1]), 1):
            while (below := step.get(state << 9 | symbol)) is None and state:
                state = shorter[state]
            state = below or 0
            last.append(next(t for t in ending[state] if sizes[t] == done or self._stay_apart_until(last[done - sizes[t]], t, 1 << 30)))
        out, done = [], len(raw)
        while done:
            out.append(self.id_bytes[last[done]])
            done -= sizes[last[done]]
        return b"".join(out[::-1])

    def _keep(self, found: dict[str, bytes]) -> None:
        for word, ids in found.items():
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= self.cache_words:
                    self.words, self.older = {}, self.words
                self.words[word] = ids

    def _resolve(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of pieces without white space that aren't among the newer words."""
        words, older, findall = self.words, self.older, self.word.findall
        found: dict[str, bytes] = {}
        several: list[tuple[str, list[str]]] = []
        known: dict[str, bytes] = {}
        for c in chunks:
            if c in older:
                found[c] = older[c]
            elif c.isalpha() and (c.isascii() or max(c) < OLD_LETTERS):
                known[c] = b""
            else:  # mostly letters with one sign after them; else as the file's pattern says
                head = c[:-1]
                plain = c[-1] in ENDS and head.isalpha() and (head.isascii() or max(head) < OLD_LETTERS)
                several.append((c, pieces := [head, c[-1]] if plain else findall(c)))
                for p in pieces:
                    if p not in known:
                        known[p] = words.get(p) or older.get(p) or b""
        known |= self.encode_words([p for p, ids in known.items() if not ids])
        found |= known
        for c, pieces in several:
            found[c] = b"".join([known[p] for p in pieces])
        self._keep(found)
        return found

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where each text's pieces end, and the pieces between white space: the number of
        each among the distinct ones."""
        # letter by letter: str.lower() alone would make a final sigma of some
        texts = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        if any(c in t for t in texts for c in ODD_SPACE):
            cut = pa.array([self.space.split(t) for t in texts], pa.large_list(pa.large_string()))
        else:
            cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return ends, coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings."""
        ends, which, distinct = self._cut(texts)
        ids = list(map(self.words.get, distinct))
        fresh = self._resolve({c for c, known in zip(distinct, ids, strict=True) if known is None and c})
        fresh[""] = b""
        ids = [fresh[c] if known is None else known for c, known in zip(distinct, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        upto = np.cumsum(counts)
        out = flat[np.arange(counts.sum()) + np.repeat(starts[which] - upto + counts, counts)].tobytes()
        edges = (4 * np.concatenate([[0], upto])[np.concatenate([[0], ends])]).tolist()
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit numbers. Texts that occur
        again are encoded once."""
        every, texts = texts, list(dict.fromkeys(texts))
        out: list[bytes] = []
        start, chars = 0, 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= self.together or k + 1 == len(texts):
                out += self._some(texts[start : k + 1])
                start, chars = k + 1, 0
        if len(texts) == len(every):
            return out
        coded = dict(zip(texts, out, strict=True))
        return [coded[t] for t in every]

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.cut_special is None or not any(self.cut_special.search(t) for t in texts):
            return self._together(texts)
        plain, where = [], []
        for text in texts:
            parts, at = [], 0
            for m in self.cut_special.finditer(text):
                parts += [len(plain), self.special[m[0]].to_bytes(4, "little")]
                plain.append(text[at : m.start()])
                at = m.end()
            parts.append(len(plain))
            plain.append(text[at:])
            where.append(parts)
        ids = self._together(plain)
        return [b"".join([ids[p] if isinstance(p, int) else p for p in parts]) for parts in where]

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]

    def decode_utf8(self, ids: bytes) -> tuple[bytes, int]:
        """Token names joined by spaces (the vocabulary file names no decoder) in UTF-8,
        and the number of characters."""
        numbers = np.frombuffer(ids, "<u4")
        chars = int(self.decoded_chars[numbers].sum()) + max(0, len(numbers) - 1)
        return b" ".join(map(self.decoded.__getitem__, numbers.tolist())), chars

    def decode(self, ids: bytes) -> str:
        return self.decode_utf8(ids)[0].decode()


def loader(df: DataFrame, vocabulary: str, cache_words: int = CACHE_WORDS, together: int = TOGETHER_CHARS):
    """A function that makes the coder in a task. The vocabulary file (a few MB, fixed
    size) goes to the executors as a broadcast of its text."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: coder_of(sent.value, cache_words, together)


def coder_of(content: str, cache_words: int = CACHE_WORDS, together: int = TOGETHER_CHARS) -> WordBpe:
    """One coder for each worker process, kept between its tasks."""
    key = hash((content, cache_words, together))
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = WordBpe(content, cache_words, together)
    return KEPT[key]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded``, a row for each
    row of ``docs``; the ids are decoded again from their bytes."""
    load = loader(docs, vocabulary)

    def make():
        coder = load()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha, chars = [], [], [], []
            for ids in coder.encode_texts(texts_of(batch)):
                decoded, length = coder.decode_utf8(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                chars.append(length)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(chars, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"],
            )

        return work

    return over_texts(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long", keeps=True)


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` with the ids as an array, for use in further jobs."""
    load = loader(docs, vocabulary)

    def make():
        coder = load()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([np.frombuffer(ids, "<u4").astype("int32") for ids in coder.encode_texts(texts_of(batch))], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

        return work

    return over_texts(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>", keeps=True)
