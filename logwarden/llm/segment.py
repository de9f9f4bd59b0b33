"""Word boundaries of tokenizers without a regex: code point classes, and the states of a
small automaton found with an associative scan over transition functions.

A code point's effect on the automaton is a function from states to states. Composing such
functions is associative, and the functions that can arise form a small closed set (the
transition monoid), so each is one number and composing is a table lookup. Rows of the
text are composed side by side, the rows' functions are scanned in a logarithmic number of
steps, and a second pass gives the state before every code point.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Symbols: what the automaton can tell apart.
BREAK, LETTER, ONE, R, V, L, E, NUMBER, QUOTE, OTHER, SPACE, WHITE = range(12)
# States: what came last. QUOTE_R and the like: a quote that began a token, and the letter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_SPACE, AT_WHITE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ENDED = range(11)
STATES, SYMBOLS = 11, 12
ROW = 256


def next_state(state: int, symbol: int, lead: bool) -> int:
    """``lead``: a space belongs to the token that follows it."""
    if symbol == BREAK:
        return START
    if symbol in (LETTER, ONE, R, V, L, E):
        if state == AT_QUOTE:
            return {ONE: ENDED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(symbol, IN_LETTERS)
        if (state, symbol) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
            return ENDED
        return IN_LETTERS
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == QUOTE:
        return IN_OTHER if state in (IN_OTHER, AT_QUOTE) or lead and state == AT_SPACE else AT_QUOTE
    return {OTHER: IN_OTHER, SPACE: AT_SPACE, WHITE: AT_WHITE}[symbol]


def begins(state: int, symbol: int, lead: bool) -> bool:
    """Does a token begin at a code point that is not white space?"""
    after_space = lead and state == AT_SPACE
    if symbol in (LETTER, ONE, R, V, L, E):
        within = (IN_LETTERS, QUOTE_R, QUOTE_V, QUOTE_L)
        return not after_space and state not in within and next_state(state, symbol, lead) != ENDED
    if symbol == NUMBER:
        return not after_space and (state != IN_NUMBERS or not lead)
    if symbol in (QUOTE, OTHER):
        return not after_space and state not in (IN_OTHER, AT_QUOTE)
    return symbol == BREAK


class Automaton(NamedTuple):
    step: np.ndarray  # symbol, state -> state
    begins: np.ndarray  # symbol, state -> a token begins
    member: np.ndarray  # symbol -> its function's number
    compose: np.ndarray  # first, second -> their composition's number
    apply: np.ndarray  # function's number, state -> state


@lru_cache(maxsize=2)
def automaton(lead: bool) -> Automaton:
    step = np.array([[next_state(q, s, lead) for q in range(STATES)] for s in range(SYMBOLS)], np.uint8)
    begin = np.array([[begins(q, s, lead) for q in range(STATES)] for s in range(SYMBOLS)])
    functions = list(dict.fromkeys([tuple(range(STATES)), *map(tuple, step.tolist())]))
    place = {f: k for k, f in enumerate(functions)}
    for f in functions:  # grows meanwhile
        for g in step.tolist():
            h = tuple(g[q] for q in f)
            if h not in place:
                place[h] = len(functions)
                functions.append(h)
    compose = np.array([[place[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint16)
    member = np.array([place[tuple(f)] for f in step.tolist()], np.uint16)
    return Automaton(step, begin, member, compose, np.array(functions, np.uint8))


def states_before(symbols: np.ndarray, machine: Automaton) -> np.ndarray:
    """The automaton's state before each symbol, from the start state."""
    n, size = len(symbols), len(machine.compose)
    rows = -(-n // ROW)
    padded = np.full(rows * ROW, BREAK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, ROW).T)
    compose, step = machine.compose.ravel(), machine.step.ravel()
    whole = machine.member[columns[0]]
    for column in columns[1:]:
        whole = compose[whole.astype(np.int32) * size + machine.member[column]]
    shift = 1
    while shift < rows:
        whole[shift:] = compose[whole[:-shift].astype(np.int32) * size + whole[shift:]]
        shift *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = machine.apply[whole[:-1], START]
    out = np.empty((ROW, rows), np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = step[column.astype(np.int16) * STATES + state]
    return out.T.ravel()[:n]


def boundaries(symbols: np.ndarray, lead: bool) -> np.ndarray:
    """True where a token begins; a BREAK is a token of its own. Of white space before
    other text the last code point begins a token, and so does what precedes it."""
    machine = automaton(lead)
    before = states_before(symbols, machine)
    flat = symbols.astype(np.int16) * STATES + before
    found = machine.begins.ravel()[flat]
    after = machine.step.ravel()[flat]
    white = (symbols == SPACE) | (symbols == WHITE)
    first = white & (before != AT_SPACE) & (before != AT_WHITE)
    last = white.copy()
    last[:-1] &= ~white[1:] & (symbols[1:] != BREAK)
    last[-1:] = False
    found |= first | last
    double = np.flatnonzero((after == ENDED) & (before != AT_QUOTE))
    found[double - 1] = False
    return found


@lru_cache(maxsize=2)
def symbol_table(engine: str) -> np.ndarray:
    """Symbol of every code point. Letters, numbers and white space differ by Unicode
    version; ``engine`` names the library whose own classes hold: tiktoken or tokenizers."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    classes = {"letters": _class(engine, r"\p{L}", every), "numbers": _class(engine, r"\p{N}", every), "white": _class(engine, r"\s", every)}
    table = np.full(0x110000, OTHER, np.uint8)
    table[classes["letters"]] = LETTER
    table[classes["numbers"]] = NUMBER
    table[classes["white"]] = WHITE
    for symbol, characters in ((ONE, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'"), (SPACE, " ")):
        table[[ord(c) for c in characters]] = symbol
    return table


def _class(engine: str, pattern: str, every: str) -> np.ndarray:
    if engine == "tiktoken":
        import tiktoken

        plain = {bytes([k]): k for k in range(256)}
        reader = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
        found = reader.decode_bytes(reader.encode_ordinary(every)).decode()
    else:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(pattern + "+"), behavior="removed", invert=True)
        found = "".join(word for word, _ in split.pre_tokenize_str(every))
    return np.frombuffer(found.encode("utf-32-le"), "<u4")


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def width(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return (1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)


def packed_symbols(engine: str) -> bytes:
    """:func:`symbol_table`, small enough to travel with a task: asking a library for the
    classes of all code points takes seconds, which no worker should spend again."""
    return zlib.compress(symbol_table(engine).tobytes())


@lru_cache(maxsize=2)
def unpacked_symbols(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)
