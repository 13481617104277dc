"""Token counts of byte-level BPE by finite-state transducers.

Two machines are compiled from a tokenizer file.

``Splitter`` cuts text into pieces as the file's pre-tokenizer does.  Its states read one class of code points at a time.  A stretch of text maps
states to states; the maps that classes generate under composition are finitely many, so they are numbered, with a table of products.  A text
is laid out in chunks; the maps of all chunks are found side by side, a prefix scan composes them, which gives each chunk its entry state,
and a second sweep gives the state at each place.

``Counter`` reads the bytes of a piece.  Its state is what can still matter of the bytes read: the vocabulary prefixes that end here, each with the
token before it and the number of tokens up to it, relative to the place reached.  A transition carries the change in the number of tokens.
A token may follow another exactly if BPE leaves the two bytes strings side by side as those two tokens; then the last token at each place is
unique, and the machine is deterministic.  States and transitions are compiled as texts need them and kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import words as W

CHUNK = 256  # code points
KEEP_STATES = 300_000  # compiled states in a worker; beyond, they are compiled anew
KEEP_PIECES, LONG = 800_000, 64  # pieces whose counts are kept, and the bytes of the longest

# Classes of code points.  Fixed values: the letters of the contractions that the pre-tokenizer's pattern names.
LETTER, NUMBER, OTHER, SPACE, WHITE, END, QUOTE = range(7)
SINGLE = "smdt"  # 's 'm 'd 't
DOUBLE = {"r": "e", "v": "e", "l": "l"}  # 're 've 'll
NAMED = {c: 7 + i for i, c in enumerate("smdtrvle")}
CLASSES = 7 + len(NAMED)
LETTERS = frozenset([LETTER, *NAMED.values()])


def code_point_classes(path: str) -> np.ndarray:
    """Class of each code point.  Where Python's Unicode tables know no letter or number yet but newer ones do, the tokenizer library decides."""
    out = np.full(0x110000, OTHER, np.uint8)
    newer = regex.compile(r"[\p{L}\p{N}]")
    asked = []
    for c in range(0x110000):
        if (kind := unicodedata.category(chr(c)))[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn" and newer.match(chr(c)):
            asked.append(c)
    pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str("".join(f"1{chr(c)}a" for c in asked))
    cuts = {span[0] for _, span in pieces}
    for i, c in enumerate(asked):
        out[c] = NUMBER if 3 * i + 1 not in cuts else LETTER if 3 * i + 2 not in cuts else OTHER
    for m in regex.finditer(r"\s", "".join(map(chr, range(0xD800)))):  # all white space lies below the surrogates
        out[ord(m[0])] = WHITE
    out[ord(" ")] = SPACE
    out[ord("'")] = QUOTE
    for c, kind in NAMED.items():
        out[ord(c)] = kind
    return out


class Splitter:
    """States: FRESH (nothing before), in a run of letters, numbers or others, WS (after white space), AP (a piece begins with a quote), AP + r, v or l,
    SHUT (a contraction has just ended)."""

    FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, WS, AP, AP_R, AP_V, AP_L, SHUT = range(10)
    STATES = 10
    _AFTER = {"r": AP_R, "v": AP_V, "l": AP_L}

    def __init__(self, classes: np.ndarray):
        step = np.zeros((CLASSES, self.STATES), np.uint8)
        for kind in range(CLASSES):
            for state in range(self.STATES):
                step[kind, state] = self._next(state, kind)
        self.step = step
        # Every map that classes generate, and the product of each with each class.
        maps = {tuple(range(self.STATES)): 0}
        rows, todo = [], [tuple(range(self.STATES))]
        for current in todo:
            row = []
            for kind in range(CLASSES):
                product = tuple(int(step[kind, s]) for s in current)
                if product not in maps:
                    maps[product] = len(maps)
                    todo.append(product)
                row.append(maps[product])
            rows.append(row)
        self.maps = np.array(todo, np.uint8)
        self.times = np.array(rows, np.uint16)
        self.classes = classes

    def _next(self, state: int, kind: int) -> int:
        name = next((c for c, k in NAMED.items() if k == kind), None)
        if state == self.AP and name and name in SINGLE or (state, name) in ((self.AP_R, "e"), (self.AP_V, "e"), (self.AP_L, "l")):
            return self.SHUT
        if state == self.AP and name in self._AFTER:
            return self._AFTER[name]
        if kind in LETTERS:
            return self.IN_LETTERS
        if kind == NUMBER:
            return self.IN_NUMBERS
        if kind in (SPACE, WHITE):
            return self.WS
        if kind == END:
            return self.FRESH
        # A quote opens a piece unless it goes on a run of others.  After a space it belongs to that space's piece; see states().
        if kind == QUOTE and state not in (self.IN_OTHERS, self.AP):
            return self.AP
        return self.IN_OTHERS

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """State after each code point, from FRESH, for one run of classes."""
        n = len(kinds)
        grid = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        here = np.zeros(grid.shape[1], np.uint16)
        for column in grid:
            here = self.times[here, column]
        prefix = self.maps[here]  # the map of each chunk; after the scan, of all text up to its end
        reach = 1
        while reach < len(prefix):
            prefix[reach:] = np.take_along_axis(prefix[reach:], prefix[:-reach].astype(np.int64), axis=1)
            reach *= 2
        state = np.concatenate(([self.FRESH], prefix[:-1, self.FRESH])).astype(np.uint8)
        out = np.empty_like(grid)
        for i, column in enumerate(grid):
            out[i] = state = self.step[column, state]
        return out.T.reshape(-1)[:n]

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each code point.  END marks where texts end and is a piece of its own."""
        # A quote after a plain space belongs to the space's piece, so it opens nothing: to the machine it is an ordinary mark.
        kinds = kinds.copy()
        quoted = np.flatnonzero(kinds == QUOTE)
        quoted = quoted[quoted > 0]
        kinds[quoted[kinds[quoted - 1] == SPACE]] = OTHER
        state = self.states(kinds)
        before = np.concatenate(([self.FRESH], state[:-1]))
        kind_before = np.concatenate(([END], kinds[:-1]))
        kind_after = np.concatenate((kinds[1:], [END]))
        white = (kinds == SPACE) | (kinds == WHITE)
        white_before = (kind_before == SPACE) | (kind_before == WHITE)
        white_after = (kind_after == SPACE) | (kind_after == WHITE)
        letter = np.isin(kinds, list(LETTERS))
        mark = (kinds == OTHER) | (kinds == QUOTE)
        open_ = np.isin(state, (self.AP_R, self.AP_V, self.AP_L))  # may become a contraction
        same = (letter & np.isin(before, (self.IN_LETTERS, self.AP_R, self.AP_V, self.AP_L))) | ((kinds == NUMBER) & (before == self.IN_NUMBERS)) | (mark & np.isin(before, (self.IN_OTHERS, self.AP)))
        joined = ~white & (kind_before == SPACE)  # the space before belongs to this piece
        out = ~white & ~same & ~joined & ~open_ & (state != self.SHUT)
        # White space: a run is one piece, but its last character before other text is cut off, to stand alone or to lead the next piece.
        out |= white & (~white_before | (~white_after & (kind_after != END)))
        out |= kinds == END
        # A contraction that did not come about: its letter begins a piece of letters.
        at = np.flatnonzero(open_)
        after = np.append(state, self.FRESH)[at + 1]
        out[at[after != self.SHUT]] = True
        return out


class Counter:
    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[bytes | None] = [None]
        for token in tokens:
            if self.merge(token) != [token]:
                continue  # never made from its own bytes, so never made
            at = 0
            for b in token:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                at = self.trie[at][b]
            self.token_at[at] = token
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, int] = {}
        self._restart()

    def _restart(self) -> None:
        start = ((0, b"", 0),)  # at the root of the trie, no token before, no tokens yet
        self.number = {start: 0}
        self.state = [start]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _anew(self, at: int) -> int:
        """Forget all states but this one, also in the middle of a piece; counts of pieces stay true."""
        here = self.state[at]
        self._restart()
        at = self.number.setdefault(here, len(self.state))
        if at == len(self.state):
            self.state.append(here)
            self.steps.append({})
        return at

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE: merge the leftmost pair of lowest rank until none is left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        if not left:
            return True
        got = self.fits.get((left, right))
        if got is None:
            got = self.fits[left, right] = self.merge(left + right) == [left, right]
        return got

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        here = self.state[number]
        base = here[-1][2]  # the last entry is the root: tokens up to this place
        moved, last, count = [], None, 0
        for node, before, tokens in here:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token is not None and last is None and self._may_follow(before, token):
                last, count = token, tokens + 1
            moved.append((node, before, tokens))
        if last is None:
            raise ValueError("no token ends here; the vocabulary lacks single bytes")
        new = tuple((n, b, t - count) for n, b, t in moved if self.trie[n]) + ((0, last, 0),)
        to = self.number.setdefault(new, len(self.state))
        if to == len(self.state):
            self.state.append(new)
            self.steps.append({})
        self.steps[number][byte] = (to, count - base)
        return to, count - base

    def count(self, piece: bytes) -> int:
        if len(self.known) > KEEP_PIECES:
            self.known.clear()
        if len(self.fits) > 4 * KEEP_PIECES:
            self.fits.clear()
        at, total = 0, 0
        for byte in piece:
            step = self.steps[at].get(byte)
            if step is None:
                if len(self.state) > KEEP_STATES:
                    at = self._anew(at)
                step = self._compile(at, byte)
            at, total = step[0], total + step[1]
        if len(piece) <= LONG:
            self.known[piece] = total
        return total


class TokenCounter:
    """Token counts of texts for a tokenizer file with a byte-level pre-tokenizer and BPE merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is compiled")
        # The file writes bytes as printable characters: those that are printable stand for themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        added = spec["added_tokens"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = [t["content"] for t in added]
        self.counter = Counter([raw(t) for t in model["vocab"] if t not in self.special], [(raw(a), raw(b)) for a, b in pairs])
        self.splitter = Splitter(code_point_classes(path))
        self.pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions are not compiled")

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text; special strings inside count as their one token."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.pattern.split(text) if self.pattern and any(s in text for s in self.special) else [text]
            extra[i] = len(pieces) - 1
            parts += [p for p in pieces if p]
            owner += [i] * sum(map(bool, pieces))
        if not parts:
            return extra.tolist()
        whole = "\0".join(parts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self.splitter.classes[points]
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        close = np.cumsum(length + 1) - 1
        kinds[close] = END
        begins = np.flatnonzero(self.splitter.begins(kinds))
        size = np.ones(len(points), np.int64) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate(([0], np.cumsum(size)))
        data = whole.encode("utf-8")
        cuts = place[np.append(begins, len(points))].tolist()
        count, known = self.counter.count, self.counter.known
        # END is a piece of its own and holds no text.
        real = kinds[begins] != END
        tokens = np.zeros(len(begins), np.int64)
        pieces = [data[a:b] for a, b, ok in zip(cuts, cuts[1:], real.tolist()) if ok]
        tokens[real] = [known.get(p) or count(p) for p in pieces]
        first = np.searchsorted(begins, close - length)
        np.add.at(extra, np.array(owner), np.add.reduceat(tokens, first))
        return extra.tolist()


_HELD: dict[str, TokenCounter] = {}  # one machine for each Python worker


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each whole text, as the tokenizer library counts them without begin, end or other added tokens.

    ``path`` names a tokenizer file that every executor can open.  Null and empty texts have no tokens; special strings inside a text are one token
    each.  Repeated rows each get their row; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD.clear()
            _HELD[path] = TokenCounter(path)
        for batch in batches:
            for low, high, data, _ in W.chunks(batch.column(1)):
                part = batch.slice(low, high - low)
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(_HELD[path].count(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shape = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(run, shape).withColumnRenamed("key", key)
