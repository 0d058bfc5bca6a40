"""Token counts from a compiled finite-state transducer.

A byte-pair vocabulary is compiled, state by state as texts need them, into a
deterministic transducer over bytes whose transitions carry the number of tokens they
emit (negative where a later byte merges tokens). Texts are cut into chunks, and a
chunk's state map says, for a state before it, the state behind it and the tokens
between. A map is made for the few states that can come before its chunk: behind a word
end there is one state only; inside a long word it is guessed by running a few bytes
ahead of the chunk, and maps gain the states that their neighbours' maps end in. All
chunks run in step through the transition table; then the maps compose along each text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, strings

#: Symbols in a chunk, and before it that a guess of its first state is made from.
CHUNK, AHEAD = 64, 64
#: Symbols that are run together; states are carried from one such window to the next.
WINDOW = 1 << 18
#: Rounds in which maps gain the states that the maps before them end in; what then still lacks is run on the way.
ROUNDS = 4
#: States after which the table is emptied between windows and compiled anew, which bounds its memory.
STATES = 150_000
#: Characters of a text that are normalised at once, and of all texts that are cut into words and counted at once.
PART_CHARS, BATCH_CHARS = 1 << 17, 1 << 19
LIMIT = 2048
_BLANK = re.compile(r"[ \t\n\r]")
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Classes of code points for the word pattern: blank, letter, digit, other.
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3


class Characters:
    """What the vocabulary's library knows of characters, asked once for each that occurs."""

    UNKNOWN = 255

    def __init__(self):
        from tokenizers import Regex, normalizers

        self.kind = np.full(0x110000, self.UNKNOWN, dtype=np.uint8)
        self.patterns = [(k, normalizers.Replace(Regex(p), "\0")) for k, p in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (BLANK, r"\s"))]
        self.lowercase = normalizers.Lowercase()
        self.lowered: set[str] = set()  # characters that were asked for
        self.other: dict[str, str] = {"Σ": "σ"}  # lower-cased otherwise than Python does

    def classes(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if (kind == self.UNKNOWN).any():
            new = np.unique(points[kind == self.UNKNOWN])
            every = "".join(map(chr, new.tolist()))
            self.kind[new] = OTHER
            for k, pattern in self.patterns:
                same = np.frombuffer(pattern.normalize_str(every).encode("utf-32-le"), dtype="<u4") == new
                self.kind[new[~same]] = k
            if new[0] == 0:
                self.kind[0] = OTHER  # the mark itself
            kind = self.kind[points]
        return kind

    def lower(self, text: str) -> str:
        own = set(text)
        new = own - self.lowered
        if new:
            self.lowered |= new
            ask = sorted(new - {"\n", "Σ"})
            for a, b in zip(ask, self.lowercase.normalize_str("\n".join(ask)).split("\n")):
                if a.lower() != b:
                    self.other[a] = b
        if not own.isdisjoint(self.other):
            text = text.translate({ord(a): b for a, b in self.other.items()})
        return text.lower()


@cache
def characters() -> Characters:
    return Characters()


@cache
def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: visible Latin-1 stands for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens as sequences of symbols. Symbol b is byte b inside a word, 256 + b the last byte of a word."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in model["added_tokens"]]
        suffix = model["model"]["end_of_word_suffix"]
        number = {}
        for b, c in enumerate(byte_characters()):
            number[c], number[c + suffix] = b, 256 + b
        # token -> (rank at which it forms, left half, right half); single symbols form before all merges
        self.parts: list[tuple[int, int, int]] = [(-1, -1, -1)] * 512
        self.symbols: list[tuple[int, ...]] = [(i,) for i in range(512)]
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["model"]["merges"]):
            a, b = (number[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            number[(merge[0] + merge[1]) if isinstance(merge, list) else merge.replace(" ", "")] = len(self.parts)
            self.rank[a, b] = r
            self.parts.append((r, a, b))
            self.symbols.append(self.symbols[a] + self.symbols[b])
        self._fits: dict[tuple[int, int], bool] = {}
        # a token that its own symbols do not lead to never occurs
        sound = [True] * 512
        for t in range(512, len(self.parts)):
            r, a, b = self.parts[t]
            sound.append(sound[a] and sound[b] and self._meet(a, b, r))
        # a trie of the symbols of tokens, with suffix links
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        self.depth = [0]
        for t, own in enumerate(self.symbols):
            if sound[t]:
                at = 0
                for s in own:
                    if s not in self.next[at]:
                        self.next[at][s] = len(self.next)
                        self.next.append({})
                        self.token.append(-1)
                        self.depth.append(self.depth[at] + 1)
                    at = self.next[at][s]
                self.token[at] = t
        self.link = [0] * len(self.next)
        queue = list(self.next[0].values())
        for at in queue:
            for s, to in self.next[at].items():
                back = self.link[at]
                while back and s not in self.next[back]:
                    back = self.link[back]
                self.link[to] = self.next[back].get(s, 0)
                queue.append(to)

    def _meet(self, a: int, b: int, end: int) -> bool:
        """Whether tokens a and b, side by side, stay apart until merge ``end``.

        Follows the token at a's right edge and the one at b's left edge through the
        merges that build a and b; a merge across, earlier than the next of them, would
        break both. Equal ranks go to the left.
        """
        left, right = [a], [b]
        while self.parts[left[-1]][0] >= 0:
            left.append(self.parts[left[-1]][2])
        while self.parts[right[-1]][0] >= 0:
            right.append(self.parts[right[-1]][1])
        never = 1 << 60
        while True:
            across = self.rank.get((left[-1], right[-1]), never)
            grow_a = self.parts[left[-2]][0] if len(left) > 1 else never
            grow_b = self.parts[right[-2]][0] if len(right) > 1 else never
            if grow_a == grow_b == never:
                return across >= end
            if across < grow_a and across <= grow_b:
                return False
            (left if grow_a <= grow_b else right).pop()

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a in the encoding of a word."""
        found = self._fits.get((a, b))
        if found is None:
            found = self._fits[a, b] = self._meet(a, b, 1 << 59)
        return found


class Transducer:
    """States and transitions found so far.

    A state is what the end of a prefix of a word decides about its continuations: the
    longest end that begins a token (a trie node) and, at the start of each end that does,
    the last token of the encoding up to there and its number of tokens relative to now.
    The encoding of a prefix ends in the one token that fits the encoding before it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.filled = 0
        self._room(16)
        self.start = self.number((0, ((0, -1, 0),)))

    def _room(self, bits: int) -> None:
        """An open-addressing table from state * 512 + symbol to (state, emitted tokens)."""
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.to = np.zeros(1 << bits, dtype=np.int32)
        self.emits = np.zeros(1 << bits, dtype=np.int16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        at = ((keys.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)
        found = self.keys[at]
        off = np.flatnonzero((found != keys) & (found >= 0))
        while off.size:
            at[off] = (at[off] + 1) & self.mask
            found = self.keys[at[off]]
            off = off[(found != keys[off]) & (found >= 0)]
        return at

    def put(self, key: int, to: int, emits: int) -> None:
        if 2 * self.filled > self.mask:
            full = self.keys >= 0
            keys, targets, counts = self.keys[full], self.to[full], self.emits[full]
            self._room(self.mask.bit_length() + 1)
            for k, t, c in zip(keys.tolist(), targets.tolist(), counts.tolist()):
                at = self._slot(k)
                self.keys[at], self.to[at], self.emits[at] = k, t, c
        at = self._slot(key)
        self.keys[at], self.to[at], self.emits[at] = key, to, emits
        self.filled += 1

    def _slot(self, key: int) -> int:
        at = ((key * int(_ODD)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[at] not in (-1, key):
            at = (at + 1) & self.mask
        return at

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def compile(self, state: int, symbol: int) -> None:
        v = self.vocabulary
        node, marks = self.states[state]
        # marks: (length of an end that begins a token, last token before it, count there less count now)
        before = {length: (last, count) for length, last, count in marks}
        at = node
        while symbol not in v.next[at]:
            at = v.link[at]  # the root knows every symbol
        at = v.next[at][symbol]
        end, last, count = at, None, None
        while end:
            t = v.token[end]
            if t >= 0:
                prior = before.get(v.depth[end] - 1)
                if prior is not None and (prior[0] < 0 or v.fits(prior[0], t)):
                    last, count = t, prior[1] + 1
                    break
            end = v.link[end]
        if symbol >= 256:
            to = self.start
        else:
            kept, end = [(0, last, 0)], at
            while end:
                if v.next[end]:
                    prior = before.get(v.depth[end] - 1)
                    if prior is not None:
                        kept.append((v.depth[end], prior[0], prior[1] - count))
                end = v.link[end]
            to = self.number((at, tuple(kept)))
        self.put(state * 512 + symbol, to, count)

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and counts after symbols[begin:end] of every lane, from the given states."""
        state, count = state.copy(), np.zeros(len(begin), dtype=np.int64)
        length = end - begin
        lanes = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[lanes], -np.arange(int(length.max(initial=0))), side="left")
        for step, n in enumerate(live.tolist()):
            own = lanes[:n]
            keys = state[own] * np.int64(512) + symbols[begin[own] + step]
            at = self.slots(keys)
            missing = self.keys[at] < 0
            if missing.any():
                for key in np.unique(keys[missing]).tolist():
                    self.compile(key >> 9, key & 511)
                at = self.slots(keys)
            count[own] += self.emits[at]
            state[own] = self.to[at]
        return state, count


def normal(text: str) -> str:
    """Composed and lower-cased character by character; blanks need no change, the pattern drops them."""
    if text.isascii():
        return text.lower()
    return characters().lower(unicodedata.normalize("NFC", text))


def parts_of(text: str, limit: int = PART_CHARS):
    """The text in parts of about ``limit`` characters, cut before blanks, where neither words nor normalisation cross."""
    at = 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words of all texts, and where each text's begin (one more than texts).

    Words: 's 't 're 've 'm 'll 'd where a quote begins a word; runs of letters; single
    digits; runs of other characters. A blank stands between texts.
    """
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "replace"), dtype="<u4")
    kind = characters().classes(points)
    first = np.empty(len(points), dtype=bool)
    first[:1] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((points == 0x27) & first)
    if len(quote):
        padded = np.concatenate([points, [32, 32]])
        a, b = padded[quote + 1], padded[quote + 2]
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        stop = quote + size
        first[stop[stop < len(points)]] = True
    word = kind != BLANK
    last = np.empty(len(points), dtype=bool)
    last[-1:] = True
    last[:-1] = first[1:] | ~word[1:]
    # every code point becomes its bytes; the last byte of a word is a symbol of its own
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    data = np.frombuffer(" ".join([*texts, ""]).encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum(size)
    data[ends[last] - 1] += 256
    kept = np.repeat(word, size)
    place = np.concatenate([[0], np.cumsum(kept)])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])  # in code points
    return data[kept], place[np.concatenate([[0], ends])[begins]]


def count_tokens(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    symbols, cut = symbols_of(texts)
    total = np.zeros(len(texts), dtype=np.int64)
    carried = machine.states[machine.start]
    for a in range(0, len(symbols), WINDOW):
        b = min(a + WINDOW, len(symbols))
        if len(machine.states) > STATES:
            machine.clear()
        begin = np.unique(np.concatenate([np.arange(a, b, CHUNK), cut[(cut >= a) & (cut < b)]]))
        of = np.searchsorted(cut, begin, side="right") - 1
        state, count = count_window(machine, symbols, begin, np.append(begin[1:], b), begin == cut[of], machine.number(carried))
        total += np.bincount(of, weights=count, minlength=len(texts)).astype(np.int64)
        carried = machine.states[state]
    return total


def count_window(machine: Transducer, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, fresh: np.ndarray, carried: int) -> tuple[int, np.ndarray]:
    """The state behind the last chunk and the tokens of each; ``fresh`` chunks begin a text, ``carried`` is the state before the first."""
    n, start = len(begin), machine.start
    # a map has a head, up to the first word end, that depends on the state before it, and a tail that begins in the start state
    ends = np.flatnonzero(symbols[begin[0] : end[-1]] >= 256) + begin[0] + 1
    nearest = np.append(ends, np.iinfo(np.int64).max)[np.searchsorted(ends, begin, side="right")]
    settled = nearest <= end
    head = np.where(settled, nearest, end)
    after, tail = machine.run(symbols, head, end, np.full(n, start, dtype=np.int64))
    # the state before a chunk, known or guessed
    known = fresh.copy()
    known[0] = True
    known[1:] |= settled[:-1]
    before = np.full(n, start, dtype=np.int64)
    before[1:] = np.where(settled[:-1], after[:-1], start)
    before[fresh] = start
    if not fresh[0]:
        before[0] = carried
    guessed = np.flatnonzero(~known)
    if len(guessed):
        before[guessed] = machine.run(symbols, np.maximum(begin[guessed] - AHEAD, begin[0]), begin[guessed], np.full(len(guessed), start, dtype=np.int64))[0]
    behind, count = machine.run(symbols, begin, head, before)
    count = count + tail
    behind = np.where(settled, after, behind)
    if not len(guessed):
        return int(behind[-1]), count
    # maps of the chunks in long words: state before -> (state behind, tokens)
    maps = {i: {int(before[i]): (int(behind[i]), int(count[i]))} for i in {*guessed.tolist(), *(guessed - 1).tolist()}}

    def extend(wanted: list[tuple[int, int]]) -> None:
        lane, first = (np.array(x) for x in zip(*wanted))
        to, more = machine.run(symbols, begin[lane], head[lane], first)
        for i, s, t, c in zip(lane.tolist(), first.tolist(), to.tolist(), more.tolist()):
            maps[i][s] = (int(after[i]) if settled[i] else t, c + int(tail[i]))

    for _ in range(ROUNDS):
        wanted = [(i, s) for i in guessed.tolist() for s in {t for t, _ in maps[i - 1].values()} - maps[i].keys()]
        if not wanted:
            break
        extend(wanted)
    for i in guessed.tolist():  # ascending: the chunk before is final
        s = int(behind[i - 1])
        if s not in maps[i]:
            extend([(i, s)])
        behind[i], count[i] = maps[i][s]
    return int(behind[-1]), count


@cache
def machine_for(path: str) -> Transducer:
    return Transducer(Vocabulary(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the vocabulary's own library, without added tokens; a special
    string in a text is one token. Null counts as empty: 0 bytes, 0 tokens; long texts and
    long words are taken up piece by piece; repeated rows are counted alike; a null id is kept; an empty
    table gives no rows; further columns are ignored. No shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        machine = machine_for(vocabulary)
        special = machine.vocabulary.special
        for part in blocks(batches, limit=BATCH_CHARS):
            texts = strings(part.column(1))
            size = np.fromiter((len(t.encode("utf-8", "replace")) for t in texts), dtype=np.int64, count=len(texts))
            tokens = np.zeros(len(texts), dtype=np.int64)
            pieces, owner, held = [], [], 0

            def flush():
                nonlocal pieces, owner, held
                tokens[:] += np.bincount(owner, weights=count_tokens(machine, pieces), minlength=len(texts)).astype(np.int64)
                pieces, owner, held = [], [], 0

            for i, text in enumerate(texts):
                own = [text]
                if "<|" in text:
                    for mark in special:
                        tokens[i] += sum(x.count(mark) for x in own)
                        own = [y for x in own for y in x.split(mark)]
                for piece in (p for x in own for p in parts_of(x)):
                    pieces.append(normal(piece))
                    owner.append(i)
                    held += len(piece)
                    if held > BATCH_CHARS:
                        flush()
            if pieces:
                flush()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
