"""Pre-tokens of byte-level BPE without a regex: code-point classes and a scan of transition functions.

The public pattern (contractions, letters, numbers, other signs, each with one space before
it, and white space) is read as a small automaton.  Every code point has a symbol (an array
over all code points); a symbol is a function from state to state.  Functions compose
associatively, so the state before every code point comes from a blocked prefix scan: all
blocks are composed in step, block results are scanned, then read off.  Tables then say where
a slice begins: before the symbol, or one code point earlier when that shows only afterwards.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

BLOCK = 128
SEGMENT = 1 << 20

# Symbols; a text's first code point has its symbol + FIRST.
_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER, _QUOTE, _SHORT, _RV, _L, _E = range(10)
FIRST = 10
# States: what the last code point belongs to.
_START, _SP, _WS, _LET, _NUM, _OTH, _Q, _QRV, _QL, _DONE = range(10)


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    text = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, symbol in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _WHITE)):
        for run in regex.findall(kind, text):
            out[[ord(c) for c in run]] = symbol
    out[[ord(c) for c in "stmd"]] = _SHORT
    out[[ord(c) for c in "rv"]] = _RV
    out[ord("l")], out[ord("e")], out[ord(" ")], out[ord("'")] = _L, _E, _SPACE, _QUOTE
    return out


@lru_cache(maxsize=1)
def tables():
    """``(next, here, before)`` by [symbol, state]: new state; a slice begins here; one began just before."""
    state = np.zeros((2 * FIRST, 10), dtype=np.uint8)
    here, before = np.zeros((2 * FIRST, 10), dtype=bool), np.zeros((2 * FIRST, 10), dtype=bool)
    for symbol in range(FIRST):
        letter = symbol in (_LETTER, _SHORT, _RV, _L, _E)
        white = symbol in (_SPACE, _WHITE)
        kind = _LET if letter else _NUM if symbol == _NUMBER else _OTH
        for s in range(10):
            if white:
                to, cut = (_SP if symbol == _SPACE else _WS), s not in (_SP, _WS)
            elif s == _SP:
                to, cut = kind, False
            elif s == _Q and symbol == _SHORT:
                to, cut = _DONE, False
            elif s == _Q and symbol in (_RV, _L):
                to, cut = (_QRV if symbol == _RV else _QL), False
            elif s == _QRV and symbol == _E or s == _QL and symbol == _L:
                to, cut = _DONE, False
            else:
                own = {_LET: _LET, _NUM: _NUM, _OTH: _OTH, _Q: _OTH, _QRV: _LET, _QL: _LET}.get(s)
                cut = own != kind
                to = _Q if symbol == _QUOTE and cut else kind
            finished = s == _QRV and symbol == _E or s == _QL and symbol == _L
            state[symbol, s], here[symbol, s] = to, cut
            before[symbol, s] = s in (_QRV, _QL) and not finished or s in (_SP, _WS) and not white
        state[symbol + FIRST, :] = state[symbol, _START]
        here[symbol + FIRST, :] = True
        before[symbol + FIRST, [_QRV, _QL]] = True
    return state, here, before


@lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray]:
    """All compositions of the symbols' functions, as ``(values, composed)``.

    Row f of ``values`` is function f by state (0 is the identity, symbol s is s + 1);
    ``composed[f, g]`` is the number of g after f.  The closure is small, so that composing two
    functions is one look-up instead of one for every state."""
    step = tables()[0]
    rows = [tuple(range(10))] + [tuple(own) for own in step.tolist()]
    number: dict[tuple, int] = {}
    for k, own in enumerate(rows):
        number.setdefault(own, k)
    at = 0
    while at < len(rows):
        for own in step.tolist():
            new = tuple(own[s] for s in rows[at])
            if new not in number:
                number[new] = len(rows)
                rows.append(new)
        at += 1
    composed = [[number[tuple(g[s] for s in f)] for g in rows] for f in rows]
    return np.array(rows, dtype=np.uint8), np.array(composed, dtype=np.uint16)


def states_before(read: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """State before every symbol of ``read`` when the first is met in ``start``, and the state after all."""
    values, composed = functions()
    n, kinds = len(read), len(values)
    if not n:
        return np.zeros(0, np.uint8), start
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[:n] = read
    padded[:n] += 1
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = composed.ravel()
    prefix = np.empty((BLOCK, blocks), dtype=np.uint16)
    whole = np.zeros(blocks, dtype=np.uint16)
    for k in range(BLOCK):
        prefix[k] = whole
        whole = flat[whole.astype(np.int32) * kinds + columns[k]]
    # Inclusive scan of the blocks' functions by doubling: later after earlier.
    hop = 1
    while hop < blocks:
        whole[hop:] = composed[whole[:-hop], whole[hop:]]
        hop *= 2
    now = np.empty(blocks, dtype=np.int32)
    now[0], now[1:] = start, values[whole[:-1], start]
    out = values.ravel()[prefix.astype(np.int32) * 10 + now].T.reshape(-1)[:n]
    return out, int(values[composed[prefix[(n - 1) % BLOCK, -1], columns[(n - 1) % BLOCK, -1]], now[-1]])


def slices(buf: np.ndarray, bounds: np.ndarray):
    """Byte offsets of the slices of the texts ``buf[bounds[r]:bounds[r + 1]]`` and each text's first slice.

    Returns ``(cuts, per_row)``: slice k is ``buf[cuts[k]:cuts[k + 1]]``, text r has the slices
    ``per_row[r]:per_row[r + 1]``."""
    size = int(bounds[-1])
    _, here, before = tables()
    at = np.flatnonzero((buf[:size] & 0xC0) != 0x80)
    points = np.frombuffer(buf[:size].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    read = symbols()[points]
    firsts = np.searchsorted(at, np.unique(bounds[:-1][bounds[:-1] < bounds[1:]]))
    read[firsts] += FIRST
    cut, state = np.zeros(len(read) + 1, dtype=bool), _START
    for a in range(0, len(read), SEGMENT):
        part = read[a:a + SEGMENT]
        own, state = states_before(part, state)
        both = part.astype(np.int16) * 10 + own
        cut[a:a + len(part)] |= here.ravel()[both]
        early = np.flatnonzero(before.ravel()[both]) + a - 1
        cut[early] = True
    if state in (_QRV, _QL):
        cut[len(read) - 1] = True
    cuts = np.append(at[np.flatnonzero(cut[:len(read)])], size)
    return cuts, np.searchsorted(cuts[:-1], bounds)
