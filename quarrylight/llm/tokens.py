"""Encoding of whole corpora with a public byte-level BPE tokenizer, without a regular expression.

Pre-tokenisation is vectorised over all codepoints of a batch of texts:

* a table gives each codepoint its class (letter, number, white space, blank, other), and one vectorised look at the
  next codepoints refines it to a symbol (an apostrophe that begins a contraction, the last of a run of white space);
* the boundaries are what a small automaton over the symbols emits. Every symbol is a function from state to state,
  and composing functions is associative: the batch is cut into blocks, the blocks' functions are composed side by
  side, a scan over the blocks gives the state each begins in, and a second pass emits all boundaries;
* the slices between boundaries are dictionary-encoded by Arrow without copying the text, each distinct slice is
  merged once (a cache keeps merged slices between batches), and the ids are laid out by offset arithmetic.

Byte offsets of the slices are kept, so every id can be traced back to its bytes (``offsets=True``).

Defined results: an empty list for empty and null texts; every other text, however long, is encoded as a whole;
strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabularies are; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Characters that are encoded at a time; a longer text makes a longer batch.
BATCH_CHARS = 1 << 20
#: Distinct slices a worker keeps merged; at this number the cache is emptied, which costs time but changes no result.
CACHE = 400_000
#: Blocks that are scanned side by side.
BLOCKS = 1024

# Symbols: what the automaton reads.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK_END, SPACE_END, SPACE = range(8)
_SYMBOLS = 8
# States: what slice is open.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, LEAD, IN_SPACE, ONE_MORE, TWO_MORE, CLOSED = range(9)
_STATES = 9

# Codepoint classes.
_C_LETTER, _C_NUMBER, _C_OTHER, _C_SPACE, _C_BLANK = range(5)
#: The characters of Unicode's White_Space property.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    of = {"L": _C_LETTER, "N": _C_NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], _C_OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = _C_SPACE
    table[0x20] = _C_BLANK
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] and cut[symbol, state]: the next state, and whether a slice begins at the symbol.

    Symbols from _SYMBOLS on are the same at the beginning of a text: whatever was open is closed.
    """
    step = np.zeros((2 * _SYMBOLS, _STATES), np.uint8)
    cut = np.ones((2 * _SYMBOLS, _STATES), bool)
    fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE, BLANK_END: LEAD, SPACE_END: IN_SPACE, SPACE: IN_SPACE}
    for sym, state in fresh.items():
        step[[sym, sym + _SYMBOLS]] = state
    # a slice goes on where its run goes on, or after the one blank that leads it
    for sym, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
        for s in (run, LEAD):
            step[sym, s], cut[sym, s] = run, False
    cut[SPACE, IN_SPACE] = False
    # the letters of a contraction
    step[LETTER, TWO_MORE], cut[LETTER, TWO_MORE] = ONE_MORE, False
    step[LETTER, ONE_MORE], cut[LETTER, ONE_MORE] = CLOSED, False
    return step, cut


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of every codepoint; starts are the indices at which a text begins."""
    kind = classes()[points]
    n = len(points)
    sym = np.array([LETTER, NUMBER, OTHER, SPACE, SPACE], np.uint8)[kind]
    last = np.zeros(n, bool)  # of its text
    last[starts[1:] - 1] = True
    last[n - 1] = True
    white = kind >= _C_SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = white[:-1] & ~white[1:]
    before_word &= ~last
    sym[before_word & (kind == _C_SPACE)] = SPACE_END
    sym[before_word & (kind == _C_BLANK)] = BLANK_END
    quote = np.flatnonzero(points == 0x27)
    quote = quote[quote < n - 1]
    quote = quote[~last[quote]]
    if len(quote):
        a = points[quote + 1]
        short = np.isin(a, [ord(c) for c in "stmd"])
        sym[quote[short]] = SHORT
        rest = quote[~short & (quote + 2 < n) & ~last[quote + 1]]
        if len(rest):
            a, b = points[rest + 1], points[rest + 2]
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            sym[rest[two]] = LONG
    sym[starts] += _SYMBOLS
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each symbol, by an associative scan of the symbols' transition functions."""
    step, cut = automaton()
    n = len(sym)
    blocks = max(1, min(BLOCKS, n // 16))
    width = -(-n // blocks)
    padded = np.full(blocks * width, _SYMBOLS + OTHER, np.uint8)
    padded[:n] = sym
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    # each block's function: where it leads from every state
    flat = step.ravel()
    f = np.broadcast_to(np.arange(_STATES, dtype=np.intp), (blocks, _STATES)).copy()
    for i, row in enumerate(grid):
        f = flat[row[:, None].astype(np.intp) * _STATES + f].astype(np.intp)
        if (f == f[:, :1]).all():
            # every block has forgotten where it began: from here its function is constant
            ends = _run(grid[i + 1 :], f[:, 0], step, cut, None)
            begin = np.concatenate([[START], ends[:-1]])
            break
    else:
        begin = _scan(f)
    out = np.empty((width, blocks), bool)
    _run(grid, begin, step, cut, out)
    return out.T.ravel()[:n]


def _scan(f: np.ndarray) -> np.ndarray:
    """The state each block begins in: an exclusive scan of the blocks' functions by doubling."""
    g = f
    d = 1
    while d < len(g):
        later = g.copy()
        later[d:] = np.take_along_axis(g[d:], g[:-d], 1)
        g = later
        d *= 2
    return np.concatenate([[START], g[:-1, START]])


def _run(grid: np.ndarray, state: np.ndarray, step: np.ndarray, cut: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    """Run all blocks side by side from the given states. With out, its rows get the boundaries."""
    flat, cuts = step.ravel(), cut.ravel()
    for i, row in enumerate(grid):
        at = row.astype(np.intp) * _STATES + state
        if out is not None:
            out[i] = cuts[at]
        state = flat[at]
    return state


class Encoder:
    """Encodes batches of texts; merged slices are cached between batches."""

    def __init__(self, name: str = "byte_bpe_50k", where: str = TOKENIZERS):
        with open(os.path.join(where, f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one slice: the pair of least rank is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] is not a or j >= n or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(ranks[p] for p in parts if p is not None)

    def slices(self, texts: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Byte offsets of all slices (one more than there are), the bytes, and the texts' byte offsets."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].to_pybytes()[offs[0] : offs[-1]] if texts.buffers()[2] is not None else b""
        offs = offs - offs[0]
        if not data:
            return np.zeros(1, np.int64), data, offs
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(size)])
        starts = np.searchsorted(at, np.unique(offs[:-1][offs[1:] > offs[:-1]]))
        cut = np.flatnonzero(boundaries(symbols(points, starts)))
        return np.append(at[cut], len(data)), data, offs

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, the texts' offsets into ids, and for each id the byte of its text at which its slice begins."""
        at, data, offs = self.slices(texts)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)]).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        merged = []
        for p in pieces.dictionary.to_pylist():
            m = cache.get(p)
            if m is None:
                m = cache[p] = self.merge(p)
            merged.append(m)
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        pool = np.fromiter((i for m in merged for i in m), np.int32, int(count.sum()))
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        n = count[which]
        end = np.cumsum(n)
        ids = pool[np.repeat(first[which] - (end - n), n) + np.arange(end[-1])]
        to = np.concatenate([[0], end])[np.searchsorted(at, offs)]
        return ids, to, np.repeat(at[:-1], n) - np.repeat(offs[:-1], np.diff(to))


@lru_cache(4)
def encoder(name: str, where: str) -> Encoder:
    return Encoder(name, where)


def _batches(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about BATCH_CHARS bytes each."""
    size = b.column(column).cast(pa.large_string())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_CHARS, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", where: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """key and ids (array<int>) of every row. With offsets=True also starts: the byte each id's slice begins at."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, where)
        for whole in batches:
            for b in _batches(whole, 1):
                ids, to, begin = enc.encode(b.column(1))
                at = pa.array(to.astype(np.int32))
                cols = [b.column(0), pa.ListArray.from_arrays(at, pa.array(ids))]
                if offsets:
                    cols.append(pa.ListArray.from_arrays(at, pa.array(begin.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "starts"][: len(cols)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + (", starts array<int>" if offsets else ""))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", where: str = TOKENIZERS) -> DataFrame:
    """key and tokens (int): the number of ids of every row, 0 for empty and null texts."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, where)
        for whole in batches:
            for b in _batches(whole, 1):
                to = enc.encode(b.column(1))[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(to).astype(np.int32))], names=[key, "tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens int")


def decode_bytes(ids: list[int], tokenizer: str = "byte_bpe_50k", where: str = TOKENIZERS) -> bytes:
    """The bytes of a list of ids."""
    enc = encoder(tokenizer, where)
    if not hasattr(enc, "pieces"):
        enc.pieces = {i: b for b, i in enc.ranks.items()}
    return b"".join(enc.pieces[i] for i in ids)


def decode(ids: list[int], tokenizer: str = "byte_bpe_50k", where: str = TOKENIZERS) -> str:
    """The text of a list of ids."""
    return decode_bytes(ids, tokenizer, where).decode("utf-8", "surrogatepass")
