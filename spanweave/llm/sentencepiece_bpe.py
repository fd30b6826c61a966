"""SentencePiece encoding and decoding of merge-type (BPE) models with a prefix table.

A BPE encoding is the only token sequence in which every token encodes to itself and every neighbouring pair encodes to that
pair.  So each prefix of a text has one last token: the candidate that an automaton finds ending there and that is compatible
with the last token of the prefix before it.  The table of last tokens is filled from left to right; ids are read off from the
right.  No piece reaches from any character into a following blank (checked against the vocabulary when it is loaded), so words
with their leading blanks are encoded on their own: the tables of all different words of some texts are filled together, prefix
by prefix, in numpy.  Texts with runs of blanks and very long words go chunk by chunk, with a bounded memory of chunks.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import slices, table

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # piece types of the model file
BPE = 2  # its model type
LETTERS = "A-Za-zÀ-ɏ"
START, WIDE = -1, 1 << 20  # no token yet; above any id
TABLE, LONG = 600_000, 100  # cells of the tables filled together, about; longer words (at most 127) go one by one


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(buf):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", buf, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<f", buf, at)[0], at + 4
        else:
            size, at = varint(at)
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


class HashTable:
    """64-bit keys to numbers from 0 on, in arrays (open addressing, linear probing)."""

    def __init__(self, keys: int):
        self._room(1 << max(8, (3 * keys).bit_length()))

    def _room(self, size: int) -> None:
        self.keys, self.values, self.count = np.full(size, -(1 << 62), np.int64), np.full(size, -1, np.int32), 0

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for unknown ones."""
        at = self._home(key)
        out, left = self.values[at], np.flatnonzero((self.keys[at] != key) & (self.values[at] >= 0))
        out[self.keys[at] != key] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            same = self.keys[at] == key[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (self.values[at] >= 0)
            left, at = left[on], at[on]
        return out

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """New, different keys."""
        if 2 * (self.count + len(key)) > len(self.keys):
            used = self.values >= 0
            key, value = np.concatenate([self.keys[used], key]), np.concatenate([self.values[used], value])
            self._room(1 << (3 * len(key)).bit_length())
        self.count += len(key)
        at, left = self._home(key), np.arange(len(key))
        while len(left):
            free = self.values[at] < 0
            self.keys[at[free]], self.values[at[free]] = key[left[free]], value[left[free]]  # of several for one place the last stays
            on = self.keys[at] != key[left]
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)


class PieceModel:
    """Vocabulary and exact encoder/decoder of one merge-type model.

    Supported: BPE models with byte fallback, the identity normalizer and no user-defined pieces; others raise ValueError.
    ``memory`` bounds the remembered chunks (two generations).
    """

    def __init__(self, blob: bytes, memory: int = 100_000):
        pieces, spec, norm = [], {}, {}
        for number, value in _fields(blob):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if spec.get(3, 1) != BPE or not spec.get(35, 0) or norm.get(2) or not norm.get(5, 1) or norm.get(4, 1) or spec.get(24, 0) or any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("only BPE models with byte fallback, the identity normalizer and no user-defined pieces are supported")
        self.prefix = BLANK if norm.get(3, 1) else ""
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.controls = [i for i, (_, _, t) in enumerate(pieces) if t == CONTROL]
        self.kind = [t for _, _, t in pieces]
        unk = spec.get(44, " ⁇ ".encode())
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else unk if t == UNKNOWN else p.replace(BLANK, " ").encode() for p, _, t in pieces]
        self.digits = [str(i) for i in range(len(pieces))]
        # a chunk may end wherever no piece reaches across: finest cut first that leaves every piece whole
        cuts = (f"{BLANK}*[{LETTERS}]+|{BLANK}*[^{BLANK}{LETTERS}]+|{BLANK}+", f"{BLANK}*[^{BLANK}]+|{BLANK}+", r"(?s).+")
        self.chunks = next(f for f in (re.compile(c).findall for c in cuts) if all(len(f(p)) == 1 for p in self.id))
        self.by_word = self.prefix == BLANK and cuts[2] != self.chunks.__self__.pattern
        self.names = [p for p, _, _ in pieces]
        self._grow_automaton()
        self._pairs: dict[int, bool] = {}
        self._spines()
        self._tables()
        self._half = max(1, memory // 2)
        self._parts: list[dict[str, tuple[int, ...]]] = [{}, {}]

    def _grow_automaton(self) -> None:
        """Trie of the pieces with failure links; ``_ends[state]`` has (id, length) of the pieces that end there, longest first."""
        self._goto: dict[int, int] = {}
        self._fail, self._ends = [0], [()]
        below: list[list[tuple[str, int]]] = [[]]
        for p, i in self.id.items():
            state = 0
            for c in p:
                key = state << 21 | ord(c)
                if key not in self._goto:
                    self._goto[key] = len(self._ends)
                    below[state].append((c, len(self._ends)))
                    below.append([])
                    self._fail.append(0)
                    self._ends.append(())
                state = self._goto[key]
            self._ends[state] = ((i, len(p)),)
        queue = [0]
        for state in queue:
            for c, child in below[state]:
                if state:
                    self._fail[child] = self._step(self._fail[state], c)
                self._ends[child] += self._ends[self._fail[child]]
                queue.append(child)
        self._states = len(self._ends)

    def _step(self, state: int, c: str) -> int:
        """Next state; found ones are remembered."""
        key, at = state << 21 | ord(c), state
        while (found := self._goto.get(at << 21 | ord(c))) is None and at:
            at = self._fail[at]
        found = found or 0
        if len(self._goto) < 200_000:
            self._goto[key] = found
        return found

    def _tables(self) -> None:
        """The automaton and the answers of compatibility tests as arrays, for many chunks at once."""
        moves = np.array(list(self._goto.items()), np.int64).reshape(-1, 2)
        moves = moves[np.argsort(moves[:, 0])]
        self._moves, self._targets = HashTable(len(moves)), moves[:, 1].astype(np.int32)
        self._moves.add(moves[:, 0], np.arange(len(moves), dtype=np.int32))
        self._fails = np.array(self._fail, np.int32)
        # of each state the longest piece that ends there, and the state of the next shorter one (0: none)
        self._own = np.array([e[0][0] if e else -1 for e in self._ends], np.int32)
        self._long = np.array([e[0][1] if e else 0 for e in self._ends], np.int32)
        shorter = np.zeros(len(self._ends), np.int32)
        for state, ends in enumerate(self._ends):
            if len(ends) > 1:
                at = self._fail[state]
                while len(self._ends[at]) != len(ends) - 1 or self._ends[at][0] != ends[1]:
                    at = self._fail[at]
                shorter[state] = at
        self._shorter = shorter
        self._fits = HashTable(1 << 17)

    def _stepped(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states of many at once."""
        out, left = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(left):
            found = self._moves.get(state[left].astype(np.int64) << 21 | char[left])
            hit = found >= 0
            out[left[hit]] = self._targets[found[hit]]
            left = left[~hit & (state[left] > 0)]
            state = state.copy()
            state[left] = self._fails[state[left]]
        return out

    def _compatible_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; answers are remembered in a bounded table."""
        key = left.astype(np.int64) * WIDE + right
        fit = self._fits.get(key)
        new = np.flatnonzero(fit < 0)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            answers = np.array([self.compatible(int(k) >> 20, int(k) & WIDE - 1) for k in asked], np.int32)
            if self._fits.count + len(asked) > 1 << 20:
                self._fits = HashTable(1 << 17)
            self._fits.add(asked, answers)
            fit[new] = answers[back]
        return fit == 1

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words, each led by a blank: one column of a table each, filled for many of them prefix by prefix."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        order = np.argsort(-size, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (words, ids), of each word from its end
        at = int(np.searchsorted(-size[order], -LONG))
        for i in order[:at].tolist():
            ids = self._encode_text(BLANK + words[i].as_py())
            found.append((np.full(len(ids), i), np.array(ids[::-1], np.int32)))
        while at < len(order):  # tables of bounded size
            some = order[at : at + max(1, TABLE // (int(size[order[at]]) + 1))]
            at += len(some)
            found += self._filled(words.take(pa.array(some)), some, size[some])
        who, what = (np.concatenate(x) for x in zip(*found, (np.empty(0, np.int64), np.empty(0, np.int32)), strict=True))
        put = np.lexsort((-np.arange(len(who)), who))
        who, what = who[put], what[put]
        if len(what) and what.min() < 0:  # characters outside the vocabulary are their bytes
            odd = np.flatnonzero(what < 0)
            spelt = [[self.byte_id[b] for b in chr(-2 - int(what[k])).encode()] for k in odd]
            times = np.ones(len(what), np.int64)
            times[odd] = [len(x) for x in spelt]
            who, what = np.repeat(who, times), np.repeat(what, times)
            what[what < 0] = list(chain.from_iterable(spelt))
        return np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))]), what

    def _filled(self, words: pa.StringArray, name: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tables of last tokens of words sorted by falling size; (names, ids) read off from the ends."""
        joined = "".join([BLANK + w for w in words.to_pylist()])
        flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        first, width, n = np.cumsum(size) - size, int(size[0]), len(name)
        last, back, state = np.full((width + 1, n), START, np.int32), np.zeros((width + 1, n), np.int8), np.zeros(n, np.int32)
        for k in range(1, width + 1):
            n = int(np.searchsorted(-size, -k, side="right"))
            char = flat[first[:n] + k - 1]
            state = self._stepped(state[:n], char)
            last[k, :n], back[k, :n] = -2 - char, 1  # unless a piece fits, the character stands alone
            left, cand = np.arange(n), state
            while len(left):
                has = self._own[cand] >= 0
                left, cand = left[has], cand[has]
                token, length = self._own[cand], self._long[cand]
                fit = self._compatible_many(last[k - length, left], token)
                last[k, left[fit]], back[k, left[fit]] = token[fit], length[fit]
                left, cand = left[~fit], self._shorter[cand[~fit]]
        out, rows, place = [], np.arange(len(name)), size
        while len(rows):
            out.append((name[rows], last[place, rows]))
            place = place - back[place, rows]
            rows, place = rows[place > 0], place[place > 0]
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of many texts at once, the same ids as ``encode``."""
        plain = [bool(self.by_word and t) and "  " not in t and BLANK not in t and t[0] != " " and t[-1] != " " for t in texts]
        words = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()), " ")
        coded = words.values.dictionary_encode()
        starts, known = self.encode_words(coded.dictionary)
        listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(known, pa.int32()))
        ids = listed.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(starts)[coded.indices.to_numpy()])])[words.offsets.to_numpy()]
        if all(plain):
            return ends, ids
        parts, counts, at = [], [], 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                parts.append(ids[ends[at] : ends[at + 1]])
                at += 1
            else:
                parts.append(np.array(self.encode(t), np.int32))
            counts.append(len(parts[-1]))
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate([*parts, np.empty(0, np.int32)])

    def _merged(self, text: str) -> list[str]:
        """The merge procedure itself, for the short texts of compatibility tests: best score first, leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _spines(self) -> None:
        """For quick compatibility tests: each piece's order of merging and the parts that its last merge joins.

        A piece is plain if no other has its score and its parts are plain and merged before their whole; tests of others run the
        merge procedure.
        """
        self._alone = {p: self._merged(p) == [p] for p in self.id}
        self._split = {p: halves for p in self.id if len(p) > 1 and (halves := self._last_merge(p))}
        self._time = {p: -s if len(p) > 1 else float("-inf") for p, s in self.score.items()}
        times = Counter(self._time.values())
        self._tied = {p for p, t in self._time.items() if len(p) > 1 and times[t] > 1}
        self._plain: set[str] = set()
        for p in sorted(self.id, key=len):
            parts = self._split.get(p, ())
            if len(p) == 1 or (self._alone[p] and p not in self._tied and parts and all((q in self._plain or len(q) == 1) and self._time.get(q, float("-inf")) < self._time[p] for q in parts)):
                self._plain.add(p)
        self._rises: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the merge procedure joins last."""
        symbols = list(piece)
        while len(symbols) > 2:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return (symbols[0], symbols[1]) if len(symbols) == 2 else None

    def _rise(self, name: str, side: int) -> list[tuple[str, float]]:
        """What stands at one side (0: left, 1: right) of a piece while it is merged, with the order in which it comes up."""
        key = (name, side)
        if key not in self._rises:
            out, p = [], name
            while len(p) > 1:
                out.append((p, self._time[p]))
                p = self._split[p][side]
            self._rises[key] = [(p, float("-inf")), *reversed(out)]
        return self._rises[key]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves; ``left``: an id, ``START`` (right stands alone) or a character outside the vocabulary."""
        own, name = self.names[right], self.names[left] if left >= 0 else ""
        fit = self._alone[own] if left < 0 else self._undisturbed(name, own) if name in self._plain and own in self._plain else None
        if fit is None:
            fit = self._merged(name + own) == [name, own]
        if len(self._pairs) >= 200_000:
            self._pairs.clear()
        self._pairs[left * WIDE + right] = fit
        return fit

    def _undisturbed(self, left: str, right: str) -> bool | None:
        """Whether no merge crosses the border of two plain pieces; None if equal scores leave it open.

        The sides of the border come up in order; two that stand there together merge if that comes before either grows (of
        equal merges the left one comes first).
        """
        xs, ys, i, j, never = self._rise(left, 1), self._rise(right, 0), 0, 0, float("inf")
        while True:
            x, begun = xs[i]
            y, joined = ys[j]
            x_ends = xs[i + 1][1] if i + 1 < len(xs) else never
            y_ends = ys[j + 1][1] if j + 1 < len(ys) else never
            s = self.score.get(x + y)
            if s is not None:
                if x + y in self._tied:
                    return None
                if (at := max(-s, begun, joined)) < x_ends and at <= y_ends:
                    return False
            if x_ends == y_ends == never:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def last_tokens(self, chunk: str) -> tuple[list[int], list[int]]:
        """For each prefix, by length from 0, the last token of its encoding and that token's length."""
        n = len(chunk)
        last, size, state = [START] * (n + 1), [0] * (n + 1), 0
        goto, ends, known = self._goto.get, self._ends, self._pairs.get
        for i, c in enumerate(chunk, 1):
            after = goto(state << 21 | ord(c))
            state = self._step(state, c) if after is None else after
            for t, length in ends[state]:
                before = last[i - length]
                fit = known(before * WIDE + t)
                if fit or fit is None and self.compatible(before, t):
                    last[i], size[i] = t, length
                    break
            else:
                last[i], size[i] = -2 - ord(c), 1  # a character outside the vocabulary stands alone
        return last, size

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk, recovered from the end of its table."""
        last, size = self.last_tokens(chunk)
        i, out = len(chunk), []
        while i:
            t = last[i]
            if t >= 0:
                out.append(t)
            else:
                out.extend(self.byte_id[b] for b in reversed(chr(-2 - t).encode()))
            i -= size[i]
        out.reverse()
        return tuple(out)

    def _kept(self, memory: list[dict], key: str, make) -> tuple[int, ...]:
        """From the older generation or made anew; a full young generation becomes the older one."""
        ids = memory[1].get(key)
        if ids is None:
            ids = make(key)
        if len(key) <= 64:
            if len(memory[0]) >= self._half:
                memory[1], memory[0] = memory[0], {}
            memory[0][key] = ids
        return ids

    def _encode_text(self, text: str) -> tuple[int, ...]:
        """Ids of a normalized text, chunk by chunk."""
        out, memory = [], self._parts
        for chunk in self.chunks(text):
            ids = memory[0].get(chunk)
            out.append(self._kept(memory, chunk, self.encode_chunk) if ids is None else ids)
        return tuple(chain.from_iterable(out))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without begin or end ids; none for null or empty."""
        return list(self._encode_text((self.prefix + text).replace(" ", BLANK))) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte ids join to UTF-8 (each byte that does not becomes U+FFFD), one leading blank of a first ordinary piece is dropped."""
        if not ids:
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        cut = 1 if first is not None and self.prefix and self.kind[first] not in (BYTE, UNKNOWN) and self.raw[first][:1] == b" " else 0
        if not any(c in ids for c in self.controls):
            try:
                return raw[cut:].decode()
            except UnicodeDecodeError:
                pass
        out, run = [], []  # bytes join only within a run that no other id, not even a control id, breaks
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.raw[i])
            else:
                out += [_repaired(b"".join(run)), self.raw[i].decode()]
                run = []
        return "".join([*out, _repaired(b"".join(run))])[cut:]


    def decode_texts(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """``decode`` of many id sequences at once."""
        raw = pa.array(self.raw, pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), raw.take(pa.array(ids))), b"").to_pylist()
        kind = np.array(self.kind)[ids]
        odd = np.concatenate([[0], np.cumsum(kind == CONTROL)])[offsets]
        out = []
        for k, b in enumerate(joined):
            lo, hi = int(offsets[k]), int(offsets[k + 1])
            text = None
            if lo < hi and odd[k] == odd[k + 1]:
                try:
                    text = b.decode()
                except UnicodeDecodeError:
                    pass
                else:
                    text = text[1:] if self.prefix and kind[lo] not in (BYTE, UNKNOWN) and self.raw[ids[lo]][:1] == b" " else text
            out.append(self.decode(ids[lo:hi].tolist()) if text is None else text)
        return out

    def id_digests(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """SHA-256 of each sequence's decimal ids, joined by commas."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.digits).take(pa.array(ids))), ",")
        return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]


def _repaired(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[bytes, PieceModel] = {}


def _model(blob: bytes) -> PieceModel:
    """The worker's model, built once for all its tasks."""
    key = hashlib.sha256(blob).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceModel(blob)
    return _LOADED[key]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes; a local path is read by the driver, any other by Spark."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def transcode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns ``id_col`` and the asked ``outputs`` (n_tokens, ids, decoded, ids_sha256, decoded_sha256); one row for each input
    row, repeated rows included.  A null or empty text has no ids and decodes to "".  A null id stays null.  Other columns of
    the input are not read, so their names cannot clash.  No shuffle: the model (about 0.5 MB) is broadcast, rows stream in
    parts bounded by bytes, and a lost executor repeats only its own tasks.
    """
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(read_model(spark, model_path))
    wanted = tuple(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped.value)
        for batch in batches:
            for part in slices(batch, 1):
                offsets, ids = m.encode_texts([t or "" for t in part.column(1).to_pylist()])
                decoded = m.decode_texts(offsets, ids) if {"decoded", "decoded_sha256"} & set(wanted) else []
                make = {
                    "n_tokens": lambda o=offsets: pa.array(np.diff(o), pa.int64()),
                    "ids": lambda o=offsets, i=ids: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(i, pa.int32())),
                    "decoded": lambda d=decoded: pa.array(d, pa.string()),
                    "ids_sha256": lambda o=offsets, i=ids: pa.array(m.id_digests(o, i), pa.string()),
                    "decoded_sha256": lambda d=decoded: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in d], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([part.column(0), *(make[k]() for k in wanted)], names=["__id", *wanted])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"__id {kind}, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in wanted)
    out = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
    return out.withColumnRenamed("__id", id_col)


def model_path() -> str:
    """The public 32k BPE model of the tokenizer package on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again: counts and digests."""
    return transcode(table(spark, sf_dir, "documents"), model_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
