"""Token counts by a compiled finite-state tokenizer.

The tokenizer file (byte-level BPE with the usual letter/number/punctuation pre-tokenizer) is
compiled into one deterministic transducer over UTF-8 bytes. Every transition carries the change
of the number of emitted tokens, so a text's count is the sum over its path. States are made when
they are first reached and kept in a dense table:

* The pre-tokenizer part is a small automaton over character classes with a pending white-space
  character and pending apostrophes.
* The BPE part rests on the fact that a token sequence is the encoding of its text exactly if each
  two neighbours are the encoding of theirs. Its state is the longest suffix that a vocabulary
  entry starts with, and, at each boundary inside that suffix, the last token and the count
  relative to now. Texts with equal states have the same future, so the states are finite.

Texts are cut into chunks of bytes, and a chunk's state map says for an entry state the end state
and the count. All maps that are asked for are run side by side in lockstep:

* Where two characters of different classes meet, the first of which is no white space and no
  apostrophe, the state after the second one is the same whatever came before (words, lines,
  digits and marks of any script). From the first such point on, a chunk's map is constant.
* A chunk without such a point (a run of one class) is mapped at the state that the bytes before
  it lead to from a fresh start, which is nearly always the state that the whole text leads to.
* A prefix scan then composes the maps pairwise, in blocks of 1, 2, 4 and more chunks. Where the
  left block doesn't end in a state that the right one is mapped at, the right one's map is
  extended by that state, chunk by chunk until it meets a path it has. As maps are exact, so are
  the counts, however the states were guessed.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from textloom.llm.common import tidy

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Modes of the pre-tokenizer; L, N and P are inside a piece of letters, numbers or other characters.
START, IN_L, IN_N, IN_P, IN_S, QUOTE, QUOTE_X = range(7)
CHUNK = 1024
#: Below trie nodes with at most so many tokens, states keep what can follow instead of the last token.
SMALL = 32
NEVER = 1 << 60
#: A chunk without a synchronising point is mapped at the state that so many bytes before it lead to.
LOOK_BACK = 64
#: Beyond so many states (1 KB each) the table starts anew with those in use, also within a text.
MAX_STATES = 120_000
#: Answers kept about tokens that meet.
MAX_ANSWERS = 300_000
#: Table entries are the next state, shifted, and the change of the count, moved up by half the range.
SHIFT = 10
HALF = 1 << SHIFT - 1
#: After an apostrophe, these letters end a piece at once, or with the letter named.
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


def character_classes(pre_tokenize) -> bytes:
    """The class of every code point, as the library's own pre-tokenizer sees it.

    Two Unicode versions are at hand; where they agree their class is taken, elsewhere the
    pre-tokenizer is asked.
    """
    every = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, points):
            every[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    every[0xD800:0xE000] = OTHER
    kinds = {"L": LETTER, "N": NUMBER}
    for c in points:
        known = kinds.get(unicodedata.category(c)[0], SPACE if c.isspace() else OTHER)
        if known != every[ord(c)]:
            every[ord(c)] = next((k for k, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(pre_tokenize(probe + c)) == 1), SPACE)
    return every.tobytes()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones as they are, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """What the executors need of a tokenizer file: tokens, merges, special strings and character classes."""
    from tokenizers import Tokenizer

    text = open(path, encoding="utf-8").read()
    spec = json.loads(text)
    plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or any(spec["model"].get(k, v) not in (v, "", None) for k, v in plain.items()) or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without normalizer, prefix space or dropout can be compiled")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special strings that take white space with them can't be compiled")
    of = byte_alphabet()
    if max(map(len, spec["model"]["vocab"])) > HALF // 4:  # a step changes the count by no more than a few tokens' lengths
        raise ValueError("tokens are too long")
    as_bytes = lambda s: bytes(of[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {
        "digest": hashlib.sha256(text.encode()).hexdigest(),
        "merges": [(as_bytes(a), as_bytes(b)) for a, b in merges],
        "tokens": [as_bytes(t) for t in spec["model"]["vocab"]],
        "special": [t["content"].encode() for t in spec["added_tokens"]],
        "classes": zlib.compress(character_classes(Tokenizer.from_str(text).pre_tokenizer.pre_tokenize_str)),
    }


class BytePairAutomaton:
    """The BPE part: interned states and their steps by a byte."""

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: list[bytes]) -> None:
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.made = {a + b: (i, (a, b)) for (a, b), i in self.rank.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [None]
        self.sorted = sorted(tokens)
        self.reachable = [self.encode(t) == [t] for t in self.sorted]
        self.right = [self.spine(t, 1) for t in self.sorted]
        self.left = [self.spine(t, 0) for t in self.sorted]
        self.low: list[int] = [0]
        self.high: list[int] = [len(self.sorted)]
        for at, t in enumerate(self.sorted):
            node = 0
            for b in t:
                step = self.child[node].get(b)
                if step is None:
                    step = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(None)
                    self.low.append(at)
                    self.high.append(at + 1)
                self.high[step] = at + 1
                node = step
            if self.reachable[at]:
                self.token[node] = at
        self.fail = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            for node in level:
                for b, step in self.child[node].items():
                    self.fail[step] = self.go(self.fail[node], b)
            level = [s for node in level for s in self.child[node].values()]
        self.alone = sum(1 << i for i, ok in enumerate(self.reachable) if ok)
        self.masks: dict[tuple[int, int], int] = {}
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.empty = self.intern((0, ((0, -1, 0),)))

    def go(self, node: int, b: int) -> int:
        while b not in self.child[node] and node:
            node = self.fail[node]
        return self.child[node].get(b, 0)

    def future(self, last: int, node: int) -> int:
        """What matters of the last token before a suffix, at its trie node.

        Below a small node, that is the set of tokens which can follow, as bits, and 0 for none;
        so last tokens that allow the same are one. Below others, it is ``-2 - last``, and -1 at
        the text's begin.
        """
        if self.high[node] - self.low[node] > SMALL:
            return -2 - last if last >= 0 else -1
        found = self.masks.get((last, node))
        if found is None:
            if len(self.masks) >= MAX_ANSWERS:
                self.masks.clear()
            if last < 0:
                found = self.alone >> self.low[node] & ((1 << self.high[node] - self.low[node]) - 1)
            else:
                found = sum(1 << t - self.low[node] for t in range(self.low[node], self.high[node]) if self.reachable[t] and self.neighbours(last, t))
            self.masks[last, node] = found
        return found

    def encode(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, i = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def intern(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def feed(self, state: int, b: int) -> tuple[int, int]:
        """The state after one more byte, and the change of the number of tokens.

        A state is a trie node and, for each suffix on its chain of failures that some token can
        still begin at, longest first: the suffix's node, its future, and the count there less
        the count now.
        """
        known = self.steps.get((state, b))
        if known:
            return known
        past = self.states[state][1]
        last, gain, moved = -1, 0, []
        for node, future, rel in past:
            step = self.child[node].get(b)
            if step is None:
                continue
            if last < 0 and (t := self.token[step]) is not None and (future >> t - self.low[node] & 1 if future >= 0 else future == -1 or self.neighbours(-2 - future, t)):
                last, gain = t, rel + 1
            if self.child[step]:
                if future < 0:
                    future = self.future(-2 - future if future < -1 else -1, step)
                else:
                    future = future >> self.low[step] - self.low[node] & ((1 << self.high[step] - self.low[step]) - 1)
                if future:
                    moved.append((step, future, rel))
        if last < 0:
            raise ValueError(f"byte {b} has no token")
        hist = tuple((node, future, rel - gain) for node, future, rel in moved) + ((0, -2 - last, 0),)
        self.steps[state, b] = out = self.intern((0, hist)), gain
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b``, by their places in ``sorted``, are the encoding of their text.

        Merges go by rank, and the parts at the boundary are the right spine of ``a`` and the left
        spine of ``b``. The boundary closes if two of these parts merge before either goes into its
        own parent; of equal ranks the left one is first.
        """
        found = self.fits.get((a, b))
        if found is None:
            rank, left = self.rank, self.left[b]
            found = True
            for x, ends in self.right[a]:
                for y, until in left:
                    m = rank.get((x, y))
                    if m is not None and m < ends and m <= until:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) >= MAX_ANSWERS:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def spine(self, t: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of ``t`` at its right (1) or left (0) end, each with the rank of the merge that it goes into."""
        out, ends = [], NEVER
        while True:
            out.append((t, ends))
            if t not in self.made:
                return out
            ends, pair = self.made[t]
            t = pair[side]


class Transducer:
    """The whole tokenizer over bytes, with a dense table of the steps met so far."""

    def __init__(self, spec: dict) -> None:
        self.classes = np.frombuffer(zlib.decompress(spec["classes"]), np.uint8)
        self.special = spec["special"]
        self.splitter = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bpe = BytePairAutomaton(spec["merges"], spec["tokens"])
        self.reset()

    def reset(self) -> None:
        self.bpe.forget()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((1024, 256), -1, np.int32)
        self.start = self.intern((START, 0, 0, b""))

    def compact(self, *used: np.ndarray) -> None:
        """Starts anew with the states in ``used``, arrays of their numbers, which get the new ones."""
        states, parts = self.states, self.bpe.states
        self.reset()
        for numbers in used:
            every, back = np.unique(numbers, return_inverse=True)
            new = np.empty(len(every), numbers.dtype)
            for k, n in enumerate(every.tolist()):
                if n < 0:
                    new[k] = n
                    continue
                mode, bpe, last, part = states[n]
                new[k] = self.intern((mode, self.bpe.intern(parts[bpe]) if bpe else 0, last, part))
            numbers[:] = new[back].reshape(numbers.shape)

    def after(self, mode_of: int, text: bytes) -> int:
        """The state after a character that begins a piece; ``mode_of`` is its class."""
        mode, bpe, last, _ = self.character(START, 0, 0, text, mode_of)
        return self.intern((mode, bpe if mode not in (START, QUOTE_X) else 0, last, b""))

    def intern(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return found

    def feeds(self, state: int, text: bytes) -> tuple[int, int]:
        total = 0
        for b in text:
            state, gain = self.bpe.feed(state, b)
            total += gain
        return state, total

    def character(self, mode: int, bpe: int, last: int | bytes, text: bytes, kind: int) -> tuple[int, int, int | bytes, int]:
        """One character's step: mode, BPE state, pending character, change of the count."""
        feeds, empty = self.feeds, self.bpe.empty
        if mode == QUOTE:
            wanted = CONTRACTIONS.get(text.decode("latin-1")) if len(text) == 1 else None
            if wanted == "":
                to, gain = feeds(bpe, text)
                return START, 0, 0, gain
            if wanted:
                return QUOTE_X, 0, text, feeds(empty, text)[1]
            if kind == OTHER:
                to, gain = feeds(bpe, text)
                return IN_P, to, 0, gain
        elif mode == QUOTE_X:
            if text.decode("latin-1") == CONTRACTIONS[last.decode()]:
                return START, 0, 0, feeds(empty, b"'" + last + text)[1] - feeds(empty, b"'")[1] - feeds(empty, last)[1]
            return self.character(IN_L, feeds(empty, last)[0], 0, text, kind)
        elif mode == IN_S:
            run, held = feeds(bpe, self.pending(last))
            if kind == SPACE:
                return IN_S, run, self.code(text), feeds(run, text)[1]
            if last == 32:
                to, n = feeds(empty, b" " + text)
                return (IN_L, IN_N, 0, IN_P)[kind], to, 0, n - held
            alone = feeds(empty, self.pending(last))[1]
            to_mode, to, rest, n = self.character(START, 0, 0, text, kind)
            return to_mode, to, rest, n + alone - held
        elif mode == (IN_L, IN_N, START, IN_P)[kind] and mode != START:
            to, gain = feeds(bpe, text)
            return mode, to, 0, gain
        if kind == SPACE:
            return IN_S, empty, self.code(text), feeds(empty, text)[1]
        to, n = feeds(empty, text)
        return (QUOTE if text == b"'" else (IN_L, IN_N, 0, IN_P)[kind]), to, 0, n

    @staticmethod
    def code(text: bytes) -> int | bytes:
        return text[0] if len(text) == 1 else text

    @staticmethod
    def pending(last: int | bytes) -> bytes:
        return bytes([last]) if isinstance(last, int) else last

    def step(self, state: int, b: int) -> int:
        """A table entry."""
        mode, bpe, last, part = self.states[state]
        text = part + bytes([b])
        need = 1 if text[0] < 0xC0 else 2 if text[0] < 0xE0 else 3 if text[0] < 0xF0 else 4
        if len(text) < need:
            return self.intern((mode, bpe, last, text)) << SHIFT | HALF
        try:
            kind = int(self.classes[ord(text.decode())])
        except UnicodeDecodeError:
            kind = OTHER
        mode, bpe, last, gain = self.character(mode, bpe, last, text, kind)
        return self.intern((mode, bpe if mode not in (START, QUOTE_X) else 0, last, b"")) << SHIFT | (gain + HALF)

    def run(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, *used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the pieces of ``buf`` side by side; their end states and counts.

        ``used`` are arrays of other states that the caller goes on with.
        """
        order = np.argsort(starts - ends, kind="stable")
        pos, length = starts[order], (ends - starts)[order]
        state, total = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        live = len(order) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
        for i, n in enumerate(live):
            if len(self.states) > MAX_STATES:
                self.compact(state, *used)
            at = state[:n] * 256 + buf[pos[:n] + i]
            got = self.table.ravel()[at]
            if (missing := got < 0).any():
                for k in np.unique(at[missing]):
                    entry = self.step(int(k) >> 8, int(k) & 255)
                    self.table[int(k) >> 8, int(k) & 255] = entry
                got = self.table.ravel()[at]
            state[:n] = got >> SHIFT
            total[:n] += (got & (1 << SHIFT) - 1) - HALF
        out_state, out_total = np.empty_like(state), np.empty_like(total)
        out_state[order], out_total[order] = state, total
        return out_state, out_total

    def sync_points(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where classes change so that the state is known: the end of the second character, and its begin."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32)
        point = buf[lead].astype(np.int32)
        wide = point >= 0xC0
        n_more = wide.astype(np.int8) + (point >= 0xE0) + (point >= 0xF0)
        point[wide] &= 0x3F >> n_more[wide]
        padded = np.append(buf, np.zeros(3, np.uint8))
        for k in range(1, 4):
            more = n_more >= k
            point[more] = point[more] << 6 | (padded[lead[more] + k] & 0x3F)
        kind = self.classes[np.minimum(point, 0x10FFFF)]
        meets = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & (buf[lead[:-1]] != 39)) + 1
        return lead[meets] + n_more[meets] + 1, lead[meets]

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts ``buf[offsets[i]:offsets[i + 1]]``."""
        owner, starts, ends, extra = self.segments(buf, offsets)
        counts = np.bincount(owner, extra, minlength=len(offsets) - 1).astype(np.int64)
        # Chunks, in order; nth: the place of a chunk in its segment.
        n_chunks = np.maximum(1, -(-(ends - starts) // CHUNK))
        seg = np.repeat(np.arange(len(starts)), n_chunks)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        lo = starts[seg] + nth * CHUNK
        hi = np.minimum(lo + CHUNK, ends[seg])
        later = nth > 0
        # A chunk's head ends at its first synchronising point of which both characters are its own.
        sync, second = self.sync_points(buf) if later.any() else (np.zeros(0, np.int64),) * 2
        k = np.searchsorted(second, lo + 4)
        at = sync[np.minimum(k, max(len(sync) - 1, 0))] if len(sync) else np.zeros(len(lo), np.int64)
        has_tail = later & (k < len(sync)) & (at <= hi)
        head_end = np.where(has_tail, at, hi)
        begin = second[np.minimum(k, max(len(sync) - 1, 0))] if len(sync) else at
        known: dict[bytes, int] = {}
        entry = np.full(len(seg), self.start, np.int64)  # of heads
        tail_entry = np.full(len(seg), -1, np.int64)
        for c in np.flatnonzero(has_tail).tolist():
            text = buf[begin[c] : at[c]].tobytes()
            if text not in known:
                known[text] = self.after(int(self.classes[ord(text.decode("utf-8", "replace")[0])]), text)
            tail_entry[c] = known[text]
        # Maps that don't depend on what came before: tails, and the first chunks.
        end, total = np.full(len(seg), -1, np.int64), np.zeros(len(seg), np.int64)
        tails = np.flatnonzero(has_tail)
        fixed = np.concatenate([tails, np.flatnonzero(~later)])
        first = np.where(later[fixed], tail_entry[fixed], self.start)
        to, n = self.run(buf, np.where(later[fixed], head_end[fixed], lo[fixed]), hi[fixed], first, entry)
        end[fixed], total[fixed] = to, n
        # Entry states: what the chunk before ends in, where that is constant; else a guess.
        rest = np.flatnonzero(later)
        if len(rest):
            guessed = rest[end[rest - 1] < 0]
            entry[rest] = end[rest - 1]
            if len(guessed):
                back = lo[guessed] - LOOK_BACK
                while (inside := (buf[back] & 0xC0) == 0x80).any():
                    back = back + inside
                entry[guessed] = self.run(buf, back, lo[guessed], np.full(len(guessed), self.start), end, entry)[0]
            head = np.zeros(len(seg), np.int64)
            to, n = self.run(buf, lo[rest], head_end[rest], entry[rest], end, entry)
            head[rest] = n
            end[rest] = np.where(has_tail[rest], end[rest], to)
            # The scan, over pairs of blocks of ``width`` chunks.
            width = 1
            while width < n_chunks.max():
                asked = np.flatnonzero(nth % (2 * width) == width)
                while len(asked):
                    asked = asked[entry[asked] != end[asked - 1]]
                    entry[asked] = end[asked - 1]
                    to, n = self.run(buf, lo[asked], head_end[asked], entry[asked], end, entry)
                    head[asked] = n
                    moved = ~has_tail[asked] & (end[asked] != to)
                    end[asked] = np.where(has_tail[asked], end[asked], to)
                    after = asked[moved] + 1
                    after = after[after < len(seg)]
                    asked = after[(nth[after] % (2 * width) != 0) & (nth[after] > 0)]
                width *= 2
            total += head
        return counts + np.bincount(owner[seg], total, minlength=len(offsets) - 1).astype(np.int64)

    def segments(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, split at special strings: owner, start, end and the number of special tokens in front."""
        n = len(offsets) - 1
        found = [m.span() for m in self.splitter.finditer(buf.tobytes())] if self.splitter else []
        cuts = np.array(found, np.int64).reshape(-1, 2)
        of = np.searchsorted(offsets, cuts[:, 0], side="right") - 1
        inside = (of < n) & (cuts[:, 1] <= offsets[np.minimum(of + 1, n)])
        cuts, of = cuts[inside], of[inside]
        owner = np.concatenate([np.arange(n), of])
        starts = np.concatenate([offsets[:-1].astype(np.int64), cuts[:, 1]])
        before = np.concatenate([np.full(n, -1), cuts[:, 0]])  # where the part in front ends
        order = np.argsort(owner, kind="stable")  # cuts are in order within a text
        owner, starts, before = owner[order], starts[order], before[order]
        follows = np.append(owner[1:] == owner[:-1], False)
        ends = np.where(follows, np.append(before[1:], 0), offsets[owner + 1])
        return owner, starts, ends, (before >= 0).astype(np.int64)


#: The transducer of this Python worker, by its tokenizer's digest; later tasks go on with its states.
_compiled: dict[str, Transducer] = {}


def _transducer(spec: dict) -> Transducer:
    if spec["digest"] not in _compiled:
        _compiled.clear()
        _compiled[spec["digest"]] = Transducer(spec)
    return _compiled[spec["digest"]]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", bytes_as: str = "n_bytes", tokens_as: str = "n_tokens", batch_bytes: int = 8 << 20) -> DataFrame:
    """Adds the UTF-8 length and the number of tokens of ``text`` to ``docs``.

    Counts equal those of the library for the file, without begin, end or added special tokens;
    special strings inside texts count as one token each, which is the library's default. Null and
    empty texts have no tokens. Existing columns named like the new ones are replaced; all other
    columns, repeated rows and null keys pass through. Long texts are cut into chunks, so memory
    follows the batch of rows, of which at most ``batch_bytes`` run at once.
    """
    columns = [c for c in docs.columns if c not in (bytes_as, tokens_as)]
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    at = columns.index(text)

    @tidy
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsm = _transducer(spec.value)
        for batch in batches:
            column = batch.column(at).cast(pa.large_string()).cast(pa.large_binary())
            column = pa.compute.fill_null(column, b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            counts = np.zeros(len(column), np.int64)
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_bytes, side="right")) - 1)
                part = offsets[lo : hi + 1]
                counts[lo:hi] = fsm.count(np.append(data[part[0] : part[-1]], np.zeros(2, np.uint8)), part - part[0])
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets), pa.int64()), pa.array(counts)], [*columns, bytes_as, tokens_as])

    fields = StructType([*docs.select(*columns).schema.fields, StructField(bytes_as, LongType()), StructField(tokens_as, LongType())])
    return docs.select(*columns).mapInArrow(tables, fields)
