"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a SentencePiece model file, read on the driver. The trie runs over UTF-8
bytes; the whitespace marker of pieces is stored as the space itself, so a space
of the text is a marker, and a literal marker character in a text is an unknown character, which
byte fallback keeps exactly. A text gets one leading marker; decoding takes it off.

Texts are cut where no piece can reach across, before each run of spaces, and each
distinct chunk of a batch is segmented once. The best segmentation has the largest sum of
log scores; of equal ones the earlier start wins. A character that is no piece costs the
lowest score less 10 and becomes its bytes.

Cases: null and empty texts have no tokens and decode to the empty text; chunks of any length
are segmented whole; unknown and control ids decode to nothing; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from touchtally.llm.common import _P, _RANDOM_BYTE, SMALL_SLICE, in_arrow, prefix, row_slices, span_hash, string_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SPACE = 0x20
# Chunks above this many bytes are segmented one by one instead of side by side.
LONG_CHUNK = 96
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id of a trie state, or -1
    score: np.ndarray  # log score of an id
    byte_id: np.ndarray  # id of each byte's fallback piece
    unknown_score: float
    data: np.ndarray  # bytes of all pieces, one after the other
    at: np.ndarray  # where each piece begins in ``data``; one longer than the pieces
    is_byte: np.ndarray
    splits: bool  # no piece has a marker after another character


def double_array(keys: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays: the child of state s by byte c is base[s] + c if its check is s."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, i in zip(keys, ids):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = i
    size = 2 * len(children) + 1024
    free = np.ones(size, dtype=bool)
    free[0] = False
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    value[0] = ends[0]
    lowest = {}
    queue = [(0, 0)]
    for node, state in queue:
        codes = sorted(children[node])
        if not codes:
            base[state] = size  # leads to a cell that nobody owns
            continue
        taken = np.array(codes)
        b = lowest.get(len(codes) > 1, 1)
        while True:
            if b + 256 >= len(free):
                more = len(free)
                free = np.concatenate([free, np.ones(more, dtype=bool)])
                base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            if free[b + codes[0]] and free[b + taken].all():
                break
            b += 1
        lowest[len(codes) > 1] = max(lowest.get(len(codes) > 1, 1), b - 512)
        base[state] = b
        free[b + taken] = False
        check[b + taken] = state
        for c in codes:
            value[b + c] = ends[children[node][c]]
            queue.append((children[node][c], b + c))
    base[base == size] = len(base)
    pad = np.full(256, -2, np.int32)
    return np.concatenate([base, np.zeros(256, np.int32)]), np.concatenate([check, pad]), np.concatenate([value, pad * 0 - 1])


def load_pieces(path: str = MODEL, ranks_as_zipf: bool = True) -> Pieces:
    """Read a model file. Files of the merge kind hold ranks, not log scores: rank r then scores -ln(r + 2), Zipf's law."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    score, texts, is_byte = np.zeros(n), [], np.zeros(n, dtype=bool)
    byte_id = np.full(256, -1, np.int32)
    keys, ids = [], []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            is_byte[i] = True
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            keys.append(piece.replace(MARK, " ").encode())
            ids.append(i)
            texts.append(keys[-1])
            score[i] = -np.log(len(ids) + 1.0) if ranks_as_zipf else model.get_score(i)
    if (byte_id < 0).any():
        raise ValueError("the model has no byte pieces; byte fallback needs all 256")
    base, check, value = double_array(keys, ids)
    return Pieces(
        base, check, value, score, byte_id, float(score[ids].min() - UNKNOWN_PENALTY),
        np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), is_byte,
        all(b" " not in k.lstrip(b" ") for k in keys),
    )


def _edges(p: Pieces, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every piece found in ``data``, from each character on and not across ``stop``."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.where(data[begin] < 0x80, 1, np.where(data[begin] < 0xE0, 2, np.where(data[begin] < 0xF0, 3, 4)))
    size = np.minimum(size, stop[begin] - begin)
    at, state, depth = np.arange(len(begin)), np.zeros(len(begin), np.int32), 0
    single = np.zeros(len(begin), dtype=bool)
    starts, lengths, ids = [], [], []
    while len(at):
        inside = begin[at] + depth < stop[begin[at]]
        at, state = at[inside], state[inside]
        nxt = p.base[state] + data[begin[at] + depth]
        known = p.check[nxt] == state
        at, state = at[known], nxt[known]
        depth += 1
        found = p.value[state]
        hit = np.flatnonzero(found >= 0)
        starts.append(begin[at[hit]])
        lengths.append(np.full(len(hit), depth))
        ids.append(found[hit])
        single[at[hit][size[at[hit]] == depth]] = True
    lone = np.flatnonzero(~single)
    starts.append(begin[lone])
    lengths.append(size[lone])
    ids.append(np.full(len(lone), -1))
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)


def segment(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each chunk ``data[offsets[i]:offsets[i + 1]]``, and where each chunk's ids begin."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    stop = np.repeat(offsets[1:], lengths)
    start, size, piece = _edges(p, data, stop)
    gain = np.where(piece >= 0, p.score[piece], p.unknown_score)
    chunk = np.repeat(np.arange(n), lengths)[start]
    # Cell offsets[i] + i + k stands for the first k bytes of chunk i.
    cell = start + chunk
    best = np.full(len(data) + n, -np.inf)
    best[offsets[:-1] + np.arange(n)] = 0.0
    back = np.zeros(len(best), dtype=np.int64)
    token = np.zeros(len(best), dtype=np.int32)
    byte_cell = np.ones(len(best), dtype=bool)
    byte_cell[offsets[:-1] + np.arange(n)] = False
    inner = np.flatnonzero(byte_cell)
    back[inner] = inner - 1
    token[inner] = p.byte_id[data]  # the fallback: one byte back; edges of pieces write over it
    fallback = token.copy()
    place = start - offsets[chunk]
    order = np.lexsort((size, place))
    side = lengths[chunk[order]] <= LONG_CHUNK
    short, long = order[side], order[~side]
    for group in np.split(short, np.flatnonzero(np.diff(place[short])) + 1) if len(short) else []:
        _relax(group, cell, size, gain, piece, best, back, token, fallback)
    if len(long):
        # One chunk after the other would be as right; places ascend within every chunk.
        scores, froms, tos, gains, pieces = best, cell[long].tolist(), (cell + size)[long].tolist(), gain[long].tolist(), piece[long].tolist()
        ahead: dict[int, float] = {}
        for a, b, g, i in zip(froms, tos, gains, pieces):
            value = ahead.get(a, scores[a]) + g
            if value > ahead.get(b, -np.inf):
                ahead[b] = value
                back[b], token[b] = (a, i) if i >= 0 else (b - 1, fallback[b])
    # Walk back from every chunk's end side by side.
    at = offsets[1:] + np.arange(n)
    begin = offsets[:-1] + np.arange(n)
    active, rows, tokens = np.arange(n), [], []
    while True:
        keep = at > begin[active]
        active, at = active[keep], at[keep]
        if not len(active):
            break
        rows.append(active)
        tokens.append(token[at])
        at = back[at]
    if not rows:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    row, flat = np.concatenate(rows[::-1]), np.concatenate(tokens[::-1])
    order = np.argsort(row, kind="stable")
    return flat[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def _relax(group, cell, size, gain, piece, best, back, token, fallback) -> None:
    """Edges from one place of every chunk; their targets differ from each other."""
    source, target = cell[group], cell[group] + size[group]
    value = best[source] + gain[group]
    better = np.flatnonzero(value > best[target])
    to, of = target[better], group[better]
    best[to] = value[better]
    known = piece[of] >= 0
    back[to] = np.where(known, source[better], to - 1)
    token[to] = np.where(known, piece[of], fallback[to])


def encode(p: Pieces, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text in the buffer, and where each text's ids begin."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(raw, offsets[filled], SPACE)
    bounds = offsets + np.searchsorted(filled, np.arange(len(offsets)))
    if p.splits:
        space = data == SPACE
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[bounds[filled]] = True
        begins = np.flatnonzero(head)
    else:
        begins = bounds[filled]
    ends = np.append(begins[1:], len(data))[: len(begins)]
    keys = span_hash(prefix(_RANDOM_BYTE[data], _P), begins, ends, _P)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    every = ends - begins
    twin = first[which]
    alike = np.array_equal(every, every[twin]) and np.array_equal(data[_ranges(begins, every)], data[_ranges(begins[twin], every)])
    if not alike:
        first = which = np.arange(len(begins))
    lengths = every[first]
    distinct = np.concatenate([[0], np.cumsum(lengths)])
    chunk_data = data[_ranges(begins[first], lengths)]
    flat, at = segment(p, chunk_data, distinct)
    counts = np.diff(at)[which]
    ids = flat[_ranges(at[:-1][which], counts)]
    upto = np.concatenate([[0], np.cumsum(counts)])
    return ids, upto[np.searchsorted(begins, bounds)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] steps, one after the other."""
    total = np.cumsum(counts)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1])


def decode(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of every id sequence, without the leading marker; ids that are no text give nothing."""
    known = np.where((ids >= 0) & (ids < len(p.score)), ids, 0)
    lengths = np.diff(p.at)[known]
    data = p.data[_ranges(p.at[:-1][known], lengths)].tobytes()
    at = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:])]


def token_batches(p: Pieces, batch: pa.RecordBatch, text: str, named: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``tokenize`` of one batch, a slice at a time: the edges of a slice take about a hundred times its bytes."""
    raw, offsets = string_buffer(batch.column(text))
    for lo, hi in row_slices(offsets, SMALL_SLICE):
        part = raw[offsets[lo] : offsets[hi]]
        ids, at = encode(p, part, offsets[lo : hi + 1] - offsets[lo])
        texts = decode(p, ids, at)
        origin = part.tobytes()
        cuts = (offsets[lo : hi + 1] - offsets[lo]).tolist()
        fallback = np.concatenate([[0], np.cumsum(p.is_byte[ids])])[at]
        yield pa.record_batch(
            [
                *[batch.column(c)[lo:hi] for c in named],
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(np.diff(at), pa.int64()),
                pa.array(np.diff(fallback), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([t == origin[a:b] for t, a, b in zip(texts, cuts[:-1], cuts[1:])]),
            ],
            names=[*named, "ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "round_trip"],
        )


def tokenize(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """docs without ``text``, with ids, n_tokens, n_byte_tokens, decoded_sha256 and round_trip.

    round_trip says whether decoding the ids gives the text back.
    """
    named = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "round_trip")]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from token_batches(shared.value, batch, text, named)

    fields = [docs.schema[c] for c in named]
    schema = T.StructType([
        *fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_byte_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()),
    ])
    return in_arrow(docs.select(*named, text), run, schema)
