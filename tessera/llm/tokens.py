"""Token counts by a deterministic transducer compiled from a tokenizer's merges.

The tokenizer normalises a text, cuts it into matches of its splitting rule and applies byte-pair
merges to each, the last symbol of a match marked as its end. The transducer reads normalised characters. Its state
says how the current match stands: which rule it follows, and for every place in it at which a longer token may still begin,
that beginning, the last token before it and the tokens up to it. By a property of byte-pair merges this is enough: a sequence of
tokens is what the merges give if and only if every two neighbours are what they give for the two alone, so the
last token at a place follows from those at places before it. A transition is annotated with the change in the number of
tokens of the text, were it to end there; so what a text emits adds up to its count. States and transitions are compiled from the
vocabulary and the merges when they are first met, and kept in one hashed table that is read by whole arrays of characters.

All texts are cut into chunks of CHUNK characters. White space takes every state to the same one, so a chunk's state
map is: what it emits and its last state from its first white space on, and what stands before that, its head, to be read
from the state that the chunk before ends in. A chunk without white space is all head. Maps are composed by a
parallel prefix scan: all chunks are read side by side from their first white space, then all heads
whose entry state is known, and so on.
Texts holding a special token's string are counted by the library itself, as
those strings may join what stands on both sides of them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import PIECE_BYTES, pieces, raw, table

#: Characters of a chunk, states and checked pairs of tokens kept by a worker, and the limit that the query reports.
CHUNK, STATES, KEPT, LIMIT = 256, 300_000, 300_000, 2048
#: Lanes below which a scan goes on one character after another.
FEW = 48
#: Matches that the splitting rule takes before any other. Fixed values, as the tokenizer has them.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Classes of characters, and the states before any match and of a chunk whose entry isn't known.
SPACE, LETTER, DIGIT, OTHER = range(4)
UNKNOWN, START = 0, 1


class Merges:
    """Byte-pair merges of symbols, which are characters; the last one of a match has suffix added to it."""

    def __init__(self, merges: list, vocab: dict[str, int], suffix: str):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.suffix = suffix
        self.kept: dict[tuple[str, ...], bool] = {}
        #: Tokens, and beginnings of longer tokens, each as the one string that all states share.
        self.tokens = {t: t for t in vocab}
        self.begins: dict[str, str] = {}
        for token in vocab:
            body = token.removesuffix(suffix) if suffix and token != suffix else token
            for i in range(1, len(body)):
                self.begins.setdefault(body[:i], body[:i])

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def apply(self, symbols: list[str]) -> list[str]:
        """The tokens of a sequence of symbols: the pair of least rank first, the leftmost of equal ones."""
        parts, none = list(symbols), len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str | None, right: str) -> bool:
        """Whether the merges leave left and right as they are, side by side; without left, right by itself."""
        key = (left, right)
        known = self.kept.get(key)
        if known is None:
            if len(self.kept) > KEPT:
                self.kept.clear()
            alone = [right] if left is None else [left, right]
            known = self.kept[key] = self.apply([x for t in alone for x in self.symbols(t)]) == alone
        return known


#: The places in a match at which a longer token may begin, three values each: the symbols from there on, the last token before it, and
#: the tokens up to there less those of the match so far.
Open = tuple[str | None | int, ...]


class Transducer:
    def __init__(self, path: str, states: int = STATES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["merges"], model["vocab"], model["end_of_word_suffix"] or "")
        self.limit = states
        self.letters = _byte_letters()
        self.numbers = np.full(0x110000, -1, np.int32)  # a character's number; 0 is white space
        self.characters: list[str] = [" "]
        self.classes: list[int] = [SPACE]
        self._reset()

    def _reset(self) -> None:
        """Forgets all states; they are compiled anew."""
        self.states: list[tuple] = [("unknown",), ("start",)]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.grow(1 << 16)

    def grow(self, size: int) -> None:
        old = getattr(self, "keys", None)
        held = () if old is None or size == 1 << 16 else (old, self.nexts, self.emits)
        self.mask, self.used = size - 1, 0
        self.keys, self.nexts, self.emits = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        if held:
            known = held[0] >= 0
            for key, to, emit in zip(*(x[known].tolist() for x in held), strict=True):
                self._put(key, to, emit)

    def _put(self, key: int, to: int, emit: int) -> None:
        if 2 * self.used > self.mask:
            self.grow(2 * (self.mask + 1))
        at = self._slot(key)
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.nexts[at], self.emits[at] = key, to, emit
        self.used += 1

    def _slot(self, key: int) -> int:
        h = key * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return (h >> 32) & self.mask

    # -- compiling

    def _class(self, c: str) -> int:
        """A character's class, by what the splitting rule does with it between two others."""
        cut = lambda s: [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(s)]
        if len(cut(f"!{c}!")) == 1:
            return OTHER
        if len(cut(f"a{c}a")) == 1:
            return LETTER
        return DIGIT if len(cut(f"!{c}!")) == 3 else SPACE

    def encode(self, text: str) -> np.ndarray:
        """The numbers of a normalised text's characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.numbers[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                kind = self._class(chr(code))
                if kind == SPACE:
                    self.numbers[code] = 0
                else:
                    self.numbers[code] = len(self.characters)
                    self.characters.append(chr(code))
                    self.classes.append(kind)
            out = self.numbers[codes]
        return out

    def normalise(self, text: str) -> str:
        return text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)

    def _extend(self, opened: Open, c: str) -> tuple[Open, int, int]:
        """After the character c: the open beginnings, the match's tokens as it goes on, and its tokens if it ends here.

        Counts are relative to the tokens before c. Each byte of c is a symbol; only the last one may be the end.
        """
        data, base, ended, begins = c.encode("utf-8", "surrogatepass"), 0, 0, self.merges.begins
        for k, byte in enumerate(data):
            symbol = self.letters[byte]
            if k == len(data) - 1:
                ended = base + self._last(opened, symbol + self.merges.suffix)[1]
            token, count = self._last(opened, symbol)
            going: list = []
            for i in range(0, len(opened), 3):
                begin = begins.get(opened[i] + symbol)
                if begin is not None:
                    going += (begin, opened[i + 1], opened[i + 2] - count)
            opened, base = (*going, "", token, 0), base + count
        return opened, base, ended

    def _last(self, opened: Open, symbol: str) -> tuple[str, int]:
        """The last token of a match that goes on with symbol, and the tokens up to its end."""
        tokens, neighbours = self.merges.tokens, self.merges.neighbours
        for i in range(0, len(opened), 3):
            token = tokens.get(opened[i] + symbol)
            if token is not None and neighbours(opened[i + 1], token):
                return token, opened[i + 2] + 1
        raise ValueError("no token ends here")

    def _step(self, state: tuple, c: str, kind: int) -> tuple[tuple, int]:
        """The state after c, and the change in tokens."""
        if state == ("unknown",):
            return (("start",), 0) if kind == SPACE else (state, 0)
        if kind == SPACE:
            return ("start",), 0
        rule = state[0]
        if rule == "match" and state[1] == kind:
            return self._go(kind, c, state[3:], state[2])
        if rule == "quote":
            text, count = state[1] + c, state[2]
            if text in CONTRACTIONS:  # what counted as a quote sign and a letter is one match
                return ("start",), self._tokens(text) - count
            if len(text) == 2 and any(x.startswith(text) for x in CONTRACTIONS):
                return ("quote", text, self._tokens("'") + self._tokens(c)), self._tokens("'") + self._tokens(c) - count
            if len(text) == 2 and kind == OTHER:
                after, total = self._two("'", c, OTHER)
                return after, total - count
            if len(text) == 3 and kind == LETTER:
                after, total = self._two(text[1], c, LETTER)
                return after, total - self._tokens(text[1])
        if c == "'":
            return ("quote", c, self._tokens(c)), self._tokens(c)
        if kind == DIGIT:
            return ("start",), self._tokens(c)
        return self._go(kind, c)

    def _go(self, kind: int, c: str, opened: Open = ("", None, 0), ended: int = 0) -> tuple[tuple, int]:
        """A match of a kind starts or goes on with c; ended: its tokens if it had ended before c, beyond those as it goes on."""
        opened, base, final = self._extend(opened, c)
        return ("match", kind, final - base, *opened), final - ended

    def _two(self, first: str, c: str, kind: int) -> tuple[tuple, int]:
        """A match that starts with first and goes on with c, and its tokens."""
        state, a = self._go(kind, first)
        state, b = self._go(kind, c, state[3:], state[2])
        return state, a + b

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - a worker has one transducer
    def _tokens(self, match: str) -> int:
        symbols = [self.letters[b] for b in match.encode("utf-8", "surrogatepass")]
        return len(self.merges.apply([*symbols[:-1], symbols[-1] + self.merges.suffix]))

    def compile(self, state: int, character: int) -> tuple[int, int]:
        """Adds a transition: the next state and what it emits."""
        after, emit = self._step(self.states[state], self.characters[character], self.classes[character])
        to = self.number.setdefault(after, len(self.states))
        if to == len(self.states):
            self.states.append(after)
        self._put(state << 21 | character, to, emit)
        return to, emit

    # -- reading

    def step(self, state: np.ndarray, character: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states of many lanes, and what their transitions emit."""
        key = state.astype(np.int64) << 21 | character
        hashed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        while True:
            at = (hashed & np.uint64(self.mask)).view(np.int64)
            waiting, new = np.flatnonzero(self.keys[at] != key), []
            while len(waiting):
                free = self.keys[at[waiting]] < 0
                new.append(key[waiting[free]])
                waiting = waiting[~free]
                at[waiting] = (at[waiting] + 1) & self.mask
                waiting = waiting[self.keys[at[waiting]] != key[waiting]]
            if not any(map(len, new)):
                return self.nexts[at], self.emits[at]
            for k in np.unique(np.concatenate(new)).tolist():
                self.compile(k >> 21, k & (1 << 21) - 1)

    def run(self, state: int, characters: np.ndarray) -> tuple[int, int]:
        """One lane, character by character."""
        count = 0
        for c in characters.tolist():
            key = state << 21 | c
            at = self._slot(key)
            while self.keys[at] != key and self.keys[at] >= 0:
                at = (at + 1) & self.mask
            if self.keys[at] == key:
                state, emit = int(self.nexts[at]), int(self.emits[at])
            else:
                state, emit = self.compile(state, c)
            count += emit
        return state, count

    def read(self, state: np.ndarray, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads the first size characters of each chunk (one a row) from its state: last states and counts."""
        order = np.argsort(-size, kind="stable")
        state, rows, size = state[order].copy(), np.ascontiguousarray(chunks[order].T), size[order]
        count = np.zeros(len(order), np.int64)
        n = len(order)
        for i in range(int(size[0]) if n else 0):
            n = int(np.searchsorted(-size, -i))  # lanes longer than i
            if n <= FEW:
                for k in range(n):
                    state[k], more = self.run(int(state[k]), rows[i : size[k], k])
                    count[k] += more
                break
            state[:n], emit = self.step(state[:n], rows[i, :n])
            count[:n] += emit
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def counts(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        out, whole, codes = np.zeros(len(texts), np.int64), [], []
        if len(self.states) > self.limit:
            self._reset()
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = len(self.library.encode(text, add_special_tokens=False))
            elif text:
                whole.append(i)
                codes.append(self.encode(self.normalise(text)))
        if not whole:
            return out
        lanes = np.array([-(-len(x) // chunk) for x in codes])
        first = np.cumsum(lanes) - lanes
        chunks = np.zeros((int(lanes.sum()), chunk), np.int32)  # a text's last chunk ends in white space, which emits nothing
        flat = chunks.reshape(-1)
        for x, at in zip(codes, first.tolist(), strict=True):
            flat[at * chunk : at * chunk + len(x)] = x
        opening = np.zeros(len(chunks), bool)
        opening[first] = True
        np.add.at(out, np.repeat(np.array(whole), lanes), self.scan(chunks, opening))
        return out

    def scan(self, chunks: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """What each chunk emits, given those before it; opening: chunks that start a text."""
        width = chunks.shape[1]
        space = chunks == 0
        closed = space.any(axis=1)
        head = np.where(closed, space.argmax(axis=1), width)
        # state maps: from the first white space on, whatever comes before
        full = np.full(len(chunks), width)
        exit_, count = self.read(np.full(len(chunks), UNKNOWN), chunks, np.where(closed, full, 0))
        known = closed.copy()
        # composition: the heads, as their entry states become known
        waiting = np.flatnonzero(opening | (head > 0))
        while len(waiting):
            ready = opening[waiting] | known[waiting - 1]
            now = waiting[ready]
            entry = np.where(opening[now], START, exit_[now - 1])
            last, emitted = self.read(entry, chunks[now], head[now])
            count[now] += emitted
            exit_[now] = np.where(closed[now], exit_[now], last)
            known[now] = True
            waiting = waiting[~ready]
        return count


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit).

    A null text counts as empty (0 bytes, 0 tokens). Further columns of docs are
    ignored, whatever their names; repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(path)
        for piece in pieces(batches, limit=PIECE_BYTES):
            data = raw(piece)
            counts = counter.counts([x.decode("utf-8") for x in data]).tolist()
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
