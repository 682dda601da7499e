"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation uses no regex. All texts of a step are laid out as one array of code points; a table gives each its
class, a look at the next one or two characters refines spaces and apostrophes, and a text end resets. A small automaton
over these symbols says where slices begin. Each symbol is a transition function on the ``len(_STATES)`` states, and
functions compose associatively, so the automaton runs as a scan: blocks of symbols are composed side by side, the
blocks' functions are scanned by doubling, and then every block knows the state it starts in.

Slices are looked up in a bounded cache; unknown ones are merged together, pair by pair in order of rank, as arrays.
Ids are kept as little-endian unsigned 32-bit integers in a binary column, next to the start of each id in the text's
bytes, by which decoding places all bytes at once.

No shuffle: each task works on steps of ``STEP_CHARS`` characters of its rows. The vocabulary (a public rank file, whose
path is the caller's) is read once on the driver and sent to tasks as a broadcast, bounded by the file.

Null and empty texts have no ids and decode to no bytes. Rows are encoded one by one, in any order, repeated or not; all
other columns pass through.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STEP_CHARS = 250_000
CACHE_SLICES = 80_000
BLOCK = 512
_NONE = np.iinfo(np.int32).max

# --- fixed values: classes of the public pattern ------------------------------------------------------------------
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# symbols: classes refined by what follows
_SYMBOLS = "letter number other lead_space single_space run_space mark short_mark long_mark reset".split()
_STATES = "fresh letters numbers others spaces lead one_more two_more".split()


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a slice) by [symbol][state]."""
    to = {name: [name_to] * len(_STATES) for name, name_to in (
        ("letter", "letters"), ("number", "numbers"), ("other", "others"),
        ("lead_space", "lead"), ("single_space", "fresh"), ("run_space", "spaces"),
        ("mark", "others"), ("short_mark", "one_more"), ("long_mark", "two_more"), ("reset", "fresh"),
    )}
    goes_on = {
        ("letter", "letters"): "letters", ("letter", "lead"): "letters",
        ("letter", "one_more"): "fresh", ("letter", "two_more"): "one_more",
        ("number", "numbers"): "numbers", ("number", "lead"): "numbers",
        ("run_space", "spaces"): "spaces",
    }
    goes_on |= {(s, q): "others" for s in ("other", "mark", "short_mark", "long_mark") for q in ("others", "lead")}
    for (symbol, state), target in goes_on.items():
        to[symbol][_STATES.index(state)] = target
    following = np.array([[_STATES.index(q) for q in to[s]] for s in _SYMBOLS], np.uint8)
    starts = np.array([[(s, q) not in goes_on and s != "reset" for q in _STATES] for s in _SYMBOLS])
    return following, starts


_NEXT, _STARTS = _automaton()


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            table[point] = _LETTER if kind == "L" else _NUMBER
    table[list(WHITE_SPACE)] = _SPACE
    return table


def symbols(points: np.ndarray, resets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``resets`` are the places after each text, where a line feed stands."""
    kind = table[points]
    is_space = kind == _SPACE
    before_space = np.append(is_space[1:], True)
    out = np.array([0, 1, 5, 2], np.uint8)[kind]
    out[is_space & ~before_space] = _SYMBOLS.index("single_space")
    out[(points == 0x20) & ~before_space] = _SYMBOLS.index("lead_space")
    marks = np.flatnonzero(points == ord("'"))
    padded = np.append(points, np.zeros(2, points.dtype))
    first, second = padded[marks + 1], padded[marks + 2]
    short = np.isin(first, [ord(c) for c in CONTRACTIONS if len(c) == 1])
    long = np.zeros(len(marks), bool)
    for c in CONTRACTIONS:
        if len(c) == 2:
            long |= (first == ord(c[0])) & (second == ord(c[1]))
    out[marks] = np.where(short, 7, np.where(long, 8, 6))
    out[resets] = _SYMBOLS.index("reset")
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """State before each symbol, starting fresh, by composing transition functions."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, _SYMBOLS.index("reset"), np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.tile(np.arange(len(_STATES), dtype=np.uint8), (blocks, 1))
    for column in grid:
        whole = _NEXT[column[:, None], whole]
    step = 1
    while step < blocks:  # inclusive scan over the blocks: later function after earlier one
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), 1)
        step *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, 0]
    before = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(grid):
        before[k] = state
        state = _NEXT[column, state]
    return before.T.reshape(-1)[:n]


class Vocabulary:
    """Token bytes by id, and the id that each mergeable pair of ids becomes; arrays only, made once on the driver."""

    def __init__(self, tokens: list[bytes]):
        self.table = class_table()
        known = {token: i for i, token in enumerate(tokens)}
        self.single = np.array([known[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = known.get(token[:cut]), known.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair, or ``_NONE``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], _NONE)

    def merge_slices(self, slices: list[bytes]) -> list[bytes]:
        """Packed ids of each slice: in each round, every slice merges all its pairs of lowest rank, left to right.

        Ranks are in merge order, so a pair with a merged token ranks after the merge and the order is kept.
        """
        out: list[bytes] = [b""] * len(slices)
        sizes = np.array([len(s) for s in slices], np.int64)
        ids = self.single[np.frombuffer(b"".join(slices), np.uint8)]
        owner = np.repeat(np.arange(len(slices)), sizes)
        rank = np.full(len(ids), _NONE, np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.merged(ids[inside], ids[inside + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(first, len(ids)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == _NONE
            if done.any():
                packed = ids.astype("<u4").tobytes()
                for k, at, size in zip(owner[first[done]].tolist(), first[done].tolist(), count[done].tolist()):
                    out[k] = packed[4 * at : 4 * (at + size)]
                stay = np.repeat(~done, count)
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                lowest, count = lowest[~done], count[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, count))
            fresh = np.append(True, np.diff(hit) != 1)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            ids[hit] = rank[hit]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            paired = changed[changed + 1 < len(ids)]
            paired = paired[owner[paired] == owner[paired + 1]]
            rank[changed] = _NONE
            rank[paired] = self.merged(ids[paired], ids[paired + 1])
        return out


def load(path: str) -> Vocabulary:
    """The vocabulary of a public rank file."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return Vocabulary([ranks[i] for i in range(len(ranks))])


def _steps(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``STEP_CHARS`` characters."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > STEP_CHARS:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_texts(texts: list[str], vocabulary: Vocabulary, cache: dict[bytes, bytes]) -> tuple[list[bytes], list[bytes]]:
    """Packed ids and packed starts (in bytes) of every text of one step."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    symbol = symbols(points, ends - 1, vocabulary.table)
    begin = np.flatnonzero(_STARTS[symbol, scan(symbol)])
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    after = np.cumsum(width)
    data = "\n".join([*texts, ""]).encode()
    # a slice ends where the next one begins, or before the line feed after its text
    cuts = np.concatenate([begin, ends - 1])
    cuts.sort(kind="stable")
    bytes_at = (after - width)[cuts]
    is_end = np.isin(cuts, ends - 1)
    from_, to = bytes_at[:-1][~is_end[:-1]].tolist(), bytes_at[1:][~is_end[:-1]].tolist()
    slices = [data[a:b] for a, b in zip(from_, to)]
    unknown = list(dict.fromkeys(s for s in slices if s not in cache))
    if len(cache) + len(unknown) > CACHE_SLICES:
        cache.clear()
        unknown = list(dict.fromkeys(slices))
    cache.update(zip(unknown, vocabulary.merge_slices(unknown)))
    packed = list(map(cache.__getitem__, slices))
    per_text = np.diff(np.append(0, np.searchsorted(begin, ends))).tolist()
    ids, starts, k = [], [], 0
    for n in per_text:
        one = b"".join(packed[k : k + n])
        k += n
        lengths = vocabulary.lengths[np.frombuffer(one, "<u4")]
        ids.append(one)
        starts.append((np.cumsum(lengths) - lengths).astype("<u4").tobytes())
    return ids, starts


def decode_ids(ids: bytes, starts: bytes, vocabulary: Vocabulary) -> bytes:
    """Bytes of packed ids, each placed at its start."""
    token = np.frombuffer(ids, "<u4").astype(np.int64)
    if not len(token):
        return b""
    place = np.frombuffer(starts, "<u4").astype(np.int64)
    lengths = vocabulary.lengths[token]
    source = np.arange(place[-1] + lengths[-1]) + np.repeat(vocabulary.starts[token] - place, lengths)
    return vocabulary.pool[source].tobytes()


def _with_columns(df: DataFrame, names: list[str], work, without: list[str]) -> DataFrame:
    """``df`` plus binary columns that ``work(batch, cache)`` yields by ranges of rows: (start, end, columns)."""
    fields = [f for f in df.schema.fields if f.name not in [*names, *without]]
    schema = T.StructType([*fields, *[T.StructField(n, T.BinaryType()) for n in names]])
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for start, end, columns in work(batch, cache):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in kept] + [pa.array(c, pa.binary()) for c in columns], [*kept, *names]
                )

    return df.mapInArrow(run, schema)


def vocabulary_of(spark: SparkSession, path: str):
    """Broadcast of the rank file at ``path`` on the driver."""
    return spark.sparkContext.broadcast(load(path))


def encode(
    docs: DataFrame, shared, text_col: str = "text", ids_col: str = "ids", starts_col: str = "starts", keep_text: bool = True
) -> DataFrame:
    """``docs`` with binary columns of packed ids and of their starts in the text's bytes; ``shared``: vocabulary_of."""

    def work(batch, cache):
        texts = batch.column(text_col)
        for start, end in _steps(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            part = [t or "" for t in texts.slice(start, end - start).to_pylist()]
            yield start, end, encode_texts(part, shared.value, cache)

    return _with_columns(docs, [ids_col, starts_col], work, [] if keep_text else [text_col])


def decode(
    encoded: DataFrame, shared, ids_col: str = "ids", starts_col: str = "starts", decoded_col: str = "decoded"
) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""

    def work(batch, _):
        ids, starts = batch.column(ids_col), batch.column(starts_col)
        for start, end in _steps(pc.fill_null(pc.binary_length(ids), 0).to_pylist()):
            parts = (c.slice(start, end - start).to_pylist() for c in (ids, starts))
            yield start, end, [[decode_ids(i or b"", s or b"", shared.value) for i, s in zip(*parts)]]

    return _with_columns(encoded, [decoded_col], work, [starts_col])


def round_trip(docs: DataFrame, shared, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without its text, with packed ids and the bytes that they decode to.

    The same as ``decode(encode(docs))``, in one pass over a task's rows: ids and starts do not travel in between.
    """

    def work(batch, cache):
        texts = batch.column(text_col)
        for start, end in _steps(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            part = [t or "" for t in texts.slice(start, end - start).to_pylist()]
            ids, starts = encode_texts(part, shared.value, cache)
            yield start, end, [ids, [decode_ids(i, s, shared.value) for i, s in zip(ids, starts)]]

    return _with_columns(docs, [ids_col, decoded_col], work, [text_col])
