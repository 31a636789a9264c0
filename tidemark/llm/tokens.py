"""Exact tokenizing with public vocabularies through per-worker caches of short chunks, and tree concatenation.

A text is cut only where the tokenizer itself always starts anew, so its ids are those of its chunks in order.  Chunks
repeat far more often than texts; each worker keeps the ids of the chunks it has met, up to ``CACHE`` entries beside
those of the batch at hand.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CACHE = 300_000
SPECIAL = "<|endoftext|>"
#: The byte-level vocabulary's split pattern, white space written out as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
LONG_UNIT = 512
UNSURE_UNITS, UNSURE_CHARS = 3, 16


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: ASCII marks that no letter or digit shares a token with
MARKS = ".,!#$%&*|;:?"
#: Letters that normalizing and splitting leave as they are, lower case alone or with an optional blank before.
_PLAIN_LOWER = regex.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)()")
_PLAIN = regex.compile(rf"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([{regex.escape(MARKS)}]*)")


@cache
def byte_characters() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkCache:
    """chunk -> its ids as little-endian uint16 bytes; ids above 65,535 are refused.

    A chunk of plain letters goes to the vocabulary's merge model directly; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the cache holds 16-bit ids")
        self.known: dict = {}
        self.plain = _PLAIN if self.tokenizer.normalizer is None else _PLAIN_LOWER
        self.model = self.tokenizer.model

    def _merge(self, letters: str) -> bytes:
        written = letters.encode().decode("latin-1").translate(byte_characters())
        return array("H", [t.id for t in self.model.tokenize(written)]).tobytes()

    def learn(self, chunks, keep: bool = False) -> None:
        """Encode the chunks that are not known yet; a full cache starts anew, unless the caller must ``keep`` it."""
        known = self.known
        missing = [c for c in chunks if c not in known]
        if not keep and len(known) + len(missing) > CACHE:
            known.clear()
            missing = list(chunks)
        other, marked = [], []
        for chunk in missing:
            text = chunk.decode() if isinstance(chunk, bytes) else chunk
            found = self.plain.fullmatch(text)
            if not found:
                other.append((chunk, text))
            elif found[2]:
                marked.append((chunk, found))
            else:
                known[chunk] = self._merge(found[1])
        other += [(m, m) for m in {f[2] for _, f in marked} if m not in known]
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            coded = self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            known.update((chunk, np.array(code.ids, "<u2").tobytes()) for (chunk, _), code in zip(part, coded, strict=True))
        for chunk, found in marked:
            known[chunk] = self._merge(found[1]) + known[found[2]]

    def ids(self, chunks: list) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self.learn(dict.fromkeys(chunks))
            return b"".join(map(self.known.__getitem__, chunks))


@cache
def chunk_cache(path: str) -> ChunkCache:
    return ChunkCache(path)


#: a word of letters that lower-casing and composing leave single, and the marks at its end
_LETTERS_THEN_MARKS = re.compile(rf"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([{re.escape(MARKS)}]*)")


class WordCache:
    """White-space-free word -> its ids, for a lower-casing vocabulary that drops white space.

    A word of Latin letters and end marks is the ids of its lower-cased letters, which repeat more often than words, and
    those of the marks; any other word goes through the whole tokenizer as it stands, since special tokens are matched
    before lower-casing.
    """

    def __init__(self, path: str):
        self.held = chunk_cache(path)
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = {}, {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of a batch's distinct words.  A full cache becomes the older one, from which what is met again is
        taken back."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, (self.known, self.older[1])
        if len(self.stems) > CACHE:
            self.stems, self.older = {}, (self.older[0], self.stems)
        known, stems, merge, table = self.known, self.stems, self.held.model.tokenize, byte_characters()
        older, older_stem = (d.get for d in self.older)
        found = list(map(known.get, words))
        other: list[int] = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = older(word)
            if ids is None:
                try:
                    parts = _LETTERS_THEN_MARKS.fullmatch(word.decode())
                except UnicodeDecodeError:
                    parts = None
                if not parts:
                    other.append(i)
                    continue
                stem, marks = parts.groups()
                stem = stem.lower()
                ids = stems.get(stem)
                if ids is None:
                    ids = older_stem(stem)
                    if ids is None:
                        written = stem if stem.isascii() else stem.encode().decode("latin-1").translate(table)
                        ids = array("H", [t.id for t in merge(written)]).tobytes()
                    stems[stem] = ids
                if marks:
                    end = stems.get(marks)
                    if end is None:
                        end = stems[marks] = self._whole([marks])[0]
                    ids += end
            found[i] = known[word] = ids
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            for i, ids in zip(part, self._whole([words[i].decode("utf-8", "replace") for i in part]), strict=True):
                found[i] = known[words[i]] = ids
        return found

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(code.ids, "<u2").tobytes() for code in self.held.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def coded_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, by a lower-casing vocabulary that drops white space, and where each text ends in it: no
    token crosses an ASCII blank."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    numbered = split.flatten().dictionary_encode()
    words = numbered.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    ids = pa.array(word_cache(path).ids(words), pa.large_binary()).take(numbered.indices)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
    edges = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 2
    return np.frombuffer(ids.buffers()[2] or b"", "<u2")[: edges[-1]], edges[ends]


def word_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text."""
    ids, ends = coded_words(pa.array(texts, pa.string()), path)
    return np.split(ids, ends)[: len(texts)]


def byte_ids(text: str, path: str) -> np.ndarray:
    """Ids of the byte-level vocabulary, exactly the library's, for a text of any length."""
    chunks = text.split(" ")
    plain = SPECIAL not in text and all(c and not c[0].isspace() for c in chunks[1:]) and max(map(len, chunks)) <= LONG_UNIT
    if plain:  # a blank before a visible character always starts a unit
        return np.frombuffer(chunk_cache(path).ids(chunks[:1] + [" " + c for c in chunks[1:]] if chunks[0] else [" " + c for c in chunks[1:]]), "<u2")
    return Encoded.of(text, path).ids


def units(text: str) -> list[str]:
    """What the library encodes independently: special tokens and the pattern's matches between them."""
    parts = text.split(SPECIAL)
    found = UNIT.findall(parts[0])
    for part in parts[1:]:
        found.append(SPECIAL)
        found += UNIT.findall(part)
    return found


def unit_ids(unit: str, path: str) -> np.ndarray:
    """One unit; a long one by halves whose ids are joined exactly."""
    if len(unit) <= LONG_UNIT or unit == SPECIAL:
        return np.frombuffer(chunk_cache(path).ids([unit]), "<u2")
    half = len(unit) // 2
    return join_ids(unit_ids(unit[:half], path), unit_ids(unit[half:], path), path)


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for; byte-level vocabularies write byte b as one visible character."""
    byte_of = {c: b for b, c in byte_characters().items()}
    names = tokenizer(path)
    out = []
    for i in range(names.get_vocab_size()):
        name = names.id_to_token(i)
        out.append(bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode())
    return out


def join_ids(left: np.ndarray, right: np.ndarray, path: str) -> np.ndarray:
    """The ids of one unit from the ids of its two parts.

    A growing window of tokens around the join is encoded again until its first two and last two tokens are the old
    ones of either side.  Then every pair of neighbouring tokens stands side by side in some exact encoding, which for
    byte-pair merges makes the whole sequence the exact encoding.
    """
    table, width = token_bytes(path), 8
    while True:
        a, b = left[-width:], right[:width]
        whole_left, whole_right = width >= len(left), width >= len(right)
        try:
            window = b"".join(table[i] for i in (*a.tolist(), *b.tolist())).decode()
        except UnicodeDecodeError:  # an edge inside a character
            if whole_left and whole_right:
                raise
            width += 1
            continue
        ids = np.array(tokenizer(path).encode(window, add_special_tokens=False).ids, "<u2")
        agree_left = whole_left or (len(ids) > 3 and np.array_equal(ids[:2], a[:2]))
        agree_right = whole_right or (len(ids) > 3 and np.array_equal(ids[-2:], b[-2:]))
        if agree_left and agree_right:
            return np.concatenate([left[: max(0, len(left) - width)], ids, right[width:]])
        width *= 2


class Encoded:
    """A text with its unit ends (code points), the token count of each unit, and its ids."""

    def __init__(self, text: str, ends: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.text, self.ends, self.counts, self.ids = text, ends, counts, ids

    @classmethod
    def of(cls, text: str, path: str) -> Encoded:
        found = units(text)
        short = [u for u in found if len(u) <= LONG_UNIT]
        held = chunk_cache(path)
        if len(short) == len(found):
            ids = held.ids(found)
            return cls(text, np.cumsum([len(u) for u in found], dtype=np.int64), np.array([len(held.known[u]) // 2 for u in found], np.int64), np.frombuffer(ids, "<u2"))
        parts = [unit_ids(u, path) for u in found]
        return cls(text, np.cumsum([len(u) for u in found], dtype=np.int64), np.array([len(p) for p in parts], np.int64), np.concatenate(parts))

    def join(self, right: Encoded, path: str) -> Encoded:
        """The encoding of ``self.text + right.text``.

        All but the last units of the left side keep their place.  From there a window is cut into units again, growing
        to the right until one of its sure ends is also an end of the right side; from that point both are the same.
        """
        if not self.text or not right.text:
            return right if not self.text else self
        sure = max(0, min(len(self.ends) - UNSURE_UNITS, int(np.searchsorted(self.ends, len(self.text) - UNSURE_CHARS, "right"))))
        start = int(self.ends[sure - 1]) if sure else 0
        tail, width = self.text[start:], 256
        right_ends = np.append(0, right.ends)
        while True:
            whole = width >= len(right.text)
            found = units(tail + right.text[:width])
            ends = np.cumsum([len(u) for u in found], dtype=np.int64)
            settled = len(found) if whole else max(0, min(len(found) - UNSURE_UNITS, int(np.searchsorted(ends, len(tail) + width - UNSURE_CHARS, "right"))))
            meet = np.flatnonzero((ends[:settled] >= len(tail)) & np.isin(ends[:settled] - len(tail), right_ends))
            if len(meet):
                break
            width *= 2
        n = int(meet[0]) + 1
        skip = int(np.searchsorted(right_ends, ends[n - 1] - len(tail)))
        kept, dropped = int(self.counts[:sure].sum()), int(right.counts[:skip].sum())
        middle = [self._between(right, u, int(e) - len(u) + start, path) for u, e in zip(found[:n], ends[:n], strict=True)]
        return Encoded(
            self.text + right.text,
            np.concatenate([self.ends[:sure], ends[:n] + start, right.ends[skip:] + len(self.text)]),
            np.concatenate([self.counts[:sure], [len(m) for m in middle], right.counts[skip:]]).astype(np.int64),
            np.concatenate([self.ids[:kept], *middle, right.ids[dropped:]]),
        )

    def _between(self, right: Encoded, unit: str, at: int, path: str) -> np.ndarray:
        """Ids of a unit of the window; a long one across the join reuses the ids that either side has for its part."""
        cut = len(self.text) - at
        if len(unit) > LONG_UNIT and 0 < cut < len(unit):
            own = int(np.searchsorted(self.ends, at, "right")) == len(self.ends) - 1 and (len(self.ends) == 1 or self.ends[-2] == at)
            other = right.ends[0] == len(unit) - cut
            a = self.ids[-int(self.counts[-1]) :] if own else unit_ids(unit[:cut], path)
            b = right.ids[: int(right.counts[0])] if other else unit_ids(unit[cut:], path)
            return join_ids(a, b, path)
        return unit_ids(unit, path)


def decode_ids(ids, path: str) -> str:
    """What the byte-level library's decode gives, special tokens kept."""
    table = token_bytes(path)
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")
