"""Byte-level BPE over batches of texts, with the ids of the tokenizers library.

A batch is cut into pre-tokens with array operations, the distinct pre-tokens
(told apart by 64-bit keys) are merged once, a worker remembers them, and ids
are gathered. Which class a
character has (letter, number, white space, other) is asked of the library's
own pre-tokenizer the first time the character is met, so that both agree on
every Unicode version. Texts that hold a special token's string are encoded by
the library itself.

Defined cases: null is the empty text, which has no ids; any Unicode text,
whatever its length, is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix, strings

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBER = 400_000
_MASK = np.array([(1 << 8 * min(k, 7)) - 1 for k in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Bpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = _byte_characters()
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(back[c] for c in t): i for t, i in plain.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if [plain[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("the vocabulary's ids aren't in the order of its merges")
        self.core = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.size = 1 + max([*ranks.values(), *self.special.values()])
        pieces = [b""] * self.size
        for piece, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            pieces[i] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.kinds = np.full(0x110000, -1, np.int8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.begins = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int32)

    # -- pre-tokens ---------------------------------------------------------

    def _kind(self, c: str) -> int:
        cut = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        if cut(f"a{c}") == 1:
            return LETTER
        if cut(f"1{c}") == 1:
            return NUMBER
        return SPACE if cut(f"\n{c}") == 1 else OTHER

    def _classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds < 0).any():
            for p in np.unique(points[kinds < 0]):
                self.kinds[p] = self._kind(chr(p))
            kinds = self.kinds[points]
        return kinds

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte places at which a pre-token starts. Texts lie end to end in ``data``; each starts one."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        lead = np.flatnonzero((data & 0xC0) != 0x80) if n < len(data) else np.arange(n)
        kinds = self._classes(points)
        edge = np.zeros(n + 1, bool)  # a text starts here, or all end
        edge[np.searchsorted(lead, offsets)] = True
        space = kinds == SPACE
        blank = points == 32
        start = edge[:-1].copy()
        start[1:] |= (kinds[1:] != kinds[:-1]) & ~(blank[:-1] & ~space[1:])
        # white space before something else: all but its last character is one pre-token
        last = space.copy()
        last[:-1] &= ~space[1:]
        last &= ~edge[1:]
        last[0] &= start[0]
        after = last.copy()
        after[1:] &= space[:-1]
        start |= after
        # what follows a blank belongs to it, unless a text starts there
        # contractions: 's 't 're 've 'm 'll 'd
        quote = np.flatnonzero((points[:-1] == 39) & start[:-1]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            quote = quote[~edge[quote + 1]]
            one = points[quote + 1]
            two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0) * (~edge[np.minimum(quote + 2, n)])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            for k, places in ((2, quote[short]), (3, quote[long & ~short])):
                start[places + 1] = False
                if k == 3:
                    start[places + 2] = False
                places = places[places + k < n]
                start[places + k] = True
        return lead[start]

    # -- encoding -----------------------------------------------------------

    def _keys(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A 64-bit key of each pre-token: up to 7 bytes it is the bytes and their number, beyond that a hash."""
        starts, lengths = places[:-1], places[1:] - places[:-1]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        keys = word[starts] & _MASK[np.minimum(lengths, 8)] | np.minimum(lengths, 8).astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(lengths > 7)
        if len(long):
            at, n = starts[long], lengths[long]
            first, last = word[at], word[at + n - 8]
            middle = word[at + np.clip(n - 16, 0, 8)]
            with np.errstate(over="ignore"):
                mixed = mix(mix(mix(first + n.astype(np.uint64)) + middle) + last)
            for k in np.flatnonzero(n > 24):
                piece = data[at[k] : at[k] + n[k]].tobytes()
                mixed[k] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
            keys[long] = mixed
        return keys

    def _numbers(self, keys: np.ndarray, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A number for each pre-token; its ids are flat[ends[number]:ends[number + 1]]."""
        codes, distinct = pd.factorize(keys)
        where = np.searchsorted(self.known, distinct)
        found = where < len(self.known)
        found[found] = self.known[where[found]] == distinct[found]
        out = np.empty(len(distinct), np.int64)
        out[found] = self.number[where[found]]
        missing = np.flatnonzero(~found)
        if len(missing):
            one = np.empty(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first pre-token of each key
            raw, encode = data.tobytes(), self.core.encode_single_piece
            fresh = [encode(raw[a:b]) for a, b in zip(places[one[missing]].tolist(), places[one[missing] + 1].tolist())]
            counts = np.fromiter(map(len, fresh), np.int64, len(fresh))
            ids = np.fromiter(chain.from_iterable(fresh), self.flat.dtype, int(counts.sum()))
            out[missing] = len(self.counts) + np.arange(len(missing))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(counts) - counts]).astype(np.int32)
            self.counts = np.concatenate([self.counts, counts]).astype(np.int32)
            self.flat = np.concatenate([self.flat, ids])
            order = np.argsort(distinct[missing])
            spots = where[missing][order]
            self.known = np.insert(self.known, spots, distinct[missing][order])
            self.number = np.insert(self.number, spots, out[missing][order])
        return out[codes]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts end to end, and their n+1 offsets."""
        ids, at, _ = self.encode_pieces(column)
        return ids, at

    def encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
        """As ``encode``, and the pre-tokens: byte starts in the joined texts, and the number of ids of each."""
        data, offsets = strings(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.flat.dtype), np.zeros(n + 1, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cuts = self._cuts(data, offsets)
        places = np.concatenate([cuts, [len(data)]])
        if len(self.known) > REMEMBER:
            self._forget()
        numbers = self._numbers(self._keys(data, places), data, places)
        counts = self.counts[numbers]
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        index = np.repeat(self.begins[numbers] - total[:-1].astype(np.int32), counts)
        index += np.arange(len(index), dtype=np.int32)
        ids = self.flat[index]
        at = total[np.searchsorted(places, offsets)]
        marked = self._special_texts(column)
        if len(marked):
            parts = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
            for k in marked:
                parts[k] = np.array(self.tokenizer.encode(column[int(k)].as_py(), add_special_tokens=False).ids, ids.dtype)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, at, (cuts, counts)

    def _special_texts(self, column: pa.Array) -> np.ndarray:
        found = [pc.match_substring(column, s) for s in self.special]
        if not found:
            return np.zeros(0, np.int64)
        hit = found[0]
        for more in found[1:]:
            hit = pc.or_(hit, more)
        return np.flatnonzero(pc.fill_null(hit, False).to_numpy(zero_copy_only=False))

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the decoded text; bytes that aren't UTF-8 become U+FFFD, as in the library."""
        raw = self.raw(ids)
        return raw.decode("utf-8", "replace").encode()

    def raw(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        counts = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[np.repeat(self.starts[ids] - total[:-1], counts) + np.arange(total[-1])].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One tokenizer a worker."""
    return Bpe(path)
