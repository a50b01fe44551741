"""Secrets by patterns, and by a linear-chain conditional random field trained on what the patterns find.

Texts are cut into tokens: runs of letters, digits and bytes beyond ASCII, and every other mark for itself. Each token is tagged as
the begin of a secret, inside one, or outside, from its shape, its neighbours and the words around it, and from figures of the file.
The field is fitted on windows of a bounded sample of the corpus, labelled by the patterns. Half of the windows are shown a second time
with the words and marks around each token hidden, so that shape alone has to tell a secret too. Every whole text is decoded by
Viterbi: the texts of a slice form one chain with fresh starts, which is cut into chunks whose best scores from each entry tag to each
exit tag are found side by side and then joined, so the result is the exact best path however long a text is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm import bytesets as bs
from earthframe.llm.rows import arrow_map

#: The patterns of the contract and the characters that a find must have at least.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = rb"AKIA[A-Z0-9]+", rb"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

KINDS = ("assign", "access", "hex", "crf")
#: Documents that are looked at for training (in expectation), and windows with and without a find that the field is fitted on.
TRAIN_DOCUMENTS, FOUND_WINDOWS, PLAIN_WINDOWS = 1 << 16, 1024, 2048
#: Tokens of a training window; rounds and rate of the fit; weight of the squared weights.
WINDOW, ROUNDS, RATE, DAMPING = 24, 60, 0.2, 0.3
#: Tokens of a chunk in decoding.
CHUNK = 64
OUT, BEGIN, INSIDE = 0, 1, 2

_WORDS = 4096
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 24, 32, 40, 64])
#: Values of each feature: shape, alternation, mark, marks around, words around and own word, touching, file.
SIZES = (16 * 11, 32, 128, 144, 144, 144, _WORDS, _WORDS, _WORDS, _WORDS, 4, 64)
#: Features that the second showing hides.
CONTEXT = (3, 4, 5, 6, 7, 9)
_FIRST = np.concatenate([[0], np.cumsum(SIZES)])

_assign = re.compile(ASSIGN, re.IGNORECASE)
_access, _hex = re.compile(ACCESS), re.compile(HEX.replace(b"+", b"{%d,}" % HEX_LEAST))


def _byte_classes() -> np.ndarray:
    """Bits of each byte: 1 lower-case letter, 2 upper-case, 4 digit, 8 beyond ASCII, 16 no lower-case hexadecimal digit."""
    out = np.full(256, 16, np.uint8)
    out[ord("a"):ord("z") + 1], out[ord("A"):ord("Z") + 1], out[ord("0"):ord("9") + 1], out[128:] = 17, 18, 4, 24
    out[ord("a"):ord("f") + 1] = 1
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return out


_CLASS = _byte_classes()


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, stop, start of the secret itself) of the finds of the patterns, in bytes, in order."""
    found = []
    if b"=" in data or b":" in data:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in _assign.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m.start()) for m in _access.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    # a run of the class that is long enough is what the longer pattern finds, and a shorter one is no find of either
    found += [(m.start(), 2, m.end(), m.start()) for m in _hex.finditer(data)]
    return sorted(found)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the tokens and the tokens per text."""
    word, any_ = (_CLASS[data] & 15) > 0, _CLASS[data] > 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = any_.copy(), any_.copy()
    if len(data):
        inner = word[1:] & word[:-1] & ~edge[1:-1]
        first[1:] &= ~inner
        last[:-1] &= ~inner
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.diff(np.searchsorted(start, offsets))


def features(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of each token's feature values in the weight table, one row a feature; place 0 of a feature stands for none."""
    n = len(start)
    out = np.zeros((len(SIZES), n), np.int32)
    if not n:
        return out
    text = np.repeat(np.arange(len(count)), count)
    held = np.bitwise_or.reduceat(_CLASS[data], start)
    shape, hex_, is_word = held & 15, held < 16, (held & 15) > 0
    size = np.searchsorted(_LENGTHS, stop - start, side="right")
    digit = (_CLASS[data] & 4) > 0
    change = np.zeros(len(data) + 1, np.int32)
    np.cumsum(digit[1:] != digit[:-1], out=change[1:-1])
    turns = np.minimum(change[np.maximum(stop - 1, start)] - change[start], 15)
    letter = data[start].astype(np.int32)
    mark = np.where(is_word, 0, letter & 127)
    around = np.where(is_word, 128 + shape, mark)
    own = np.where(is_word, bs.span_hash(bs.prefix_hash(data, lower=True), start, stop) % np.uint64(_WORDS - 1) + np.uint64(1), 0).astype(np.int32)
    out[0], out[1], out[2] = shape * 11 + size, turns * 2 + hex_, mark

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """Values of the token ``by`` places on in the same text, 0 where there is none."""
        moved = np.zeros_like(values)
        if n > abs(by):
            here, there = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            moved[here] = np.where(text[here] == text[there], values[there], 0)
        return moved

    out[3], out[4], out[5] = shifted(around, -1), shifted(around, 1), shifted(around, -2)
    place = np.where(is_word, np.arange(n), -1)
    before = np.concatenate([[-1], np.maximum.accumulate(place)[:-1]])
    after = np.concatenate([np.minimum.accumulate(np.where(is_word, np.arange(n), n)[::-1])[::-1][1:], [n]])
    second = np.where(before >= 0, before[before], -1)
    for row, at in ((6, before), (7, second), (9, after)):
        there = np.clip(at, 0, n - 1)
        out[row] = np.where((at >= 0) & (at < n) & (text[there] == text), own[there], 0)
    out[8] = own
    touch = np.zeros(n, np.int32)
    touch[1:] = (start[1:] == stop[:-1]) & (text[1:] == text[:-1])
    out[10] = touch + 2 * np.append(touch[1:], 0)
    per_text = np.maximum(count, 1)
    marks, digits = (np.bincount(text, weights=w, minlength=len(count)) / per_text for w in (~is_word, (shape & 4) > 0))
    length = np.searchsorted([64, 512, 4096], count, side="right")
    file = (np.searchsorted([0.1, 0.2, 0.4], marks, side="right") * 4 + np.searchsorted([0.02, 0.1, 0.3], digits, side="right")) * 4 + length
    out[11] = file[text]
    return out + _FIRST[:-1, None].astype(np.int32)


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def fit(places: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (value, tag), transitions and start scores of the field that best explains windows of tags.

    ``places`` is (windows, WINDOW, features), ``tags`` (windows, WINDOW). Ascent on the log-likelihood with the squared
    weights as a penalty; the gradient is what is seen less what the field expects, by the forward-backward sums.
    """
    windows, length, _ = places.shape
    total = int(_FIRST[-1])
    theta = np.zeros(total * 3 + 9 + 3)
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    flat = places.reshape(windows * length, -1)
    truth = np.eye(3)[tags]
    seen_pairs = np.einsum("wip,wiq->pq", truth[:, :-1], truth[:, 1:])

    def spread(weights: np.ndarray) -> np.ndarray:
        by_tag = [np.bincount(flat.ravel(), np.repeat(weights[..., y].ravel(), flat.shape[1]), total) for y in range(3)]
        return np.stack(by_tag, axis=1)

    for step in range(1, ROUNDS + 1):
        table, move, begin = theta[:total * 3].reshape(total, 3), theta[total * 3:-3].reshape(3, 3), theta[-3:]
        score = table[flat].sum(axis=1).reshape(windows, length, 3)
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + begin
        for i in range(1, length):
            ahead[:, i] = _logsum(ahead[:, i - 1, :, None] + move, 1) + score[:, i]
        for i in range(length - 2, -1, -1):
            behind[:, i] = _logsum(move + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        whole = _logsum(ahead[:, -1], 1)[:, None, None]
        expected = np.exp(ahead + behind - whole)
        pairs = np.zeros((3, 3))
        for i in range(1, length):
            pairs += np.exp(ahead[:, i - 1, :, None] + move + (score[:, i] + behind[:, i])[:, None, :] - whole).sum(0)
        slope = np.concatenate([spread(truth - expected).ravel(), (seen_pairs - pairs).ravel(), (truth - expected)[:, 0].sum(0)])
        slope -= DAMPING * theta
        one += 0.1 * (slope - one)
        two += 0.01 * (slope * slope - two)
        theta += RATE * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
    table = theta[:total * 3].reshape(total, 3)
    return table - table[:, :1], theta[total * 3:-3].reshape(3, 3), theta[-3:]


def decode(score: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Tags of the best path through a chain; ``first`` marks tokens that start a text. Of equal paths the smaller tags win."""
    n = len(score)
    if not n:
        return np.zeros(0, np.int8)
    chunks = -(-n // CHUNK)
    score = np.concatenate([score, np.zeros((chunks * CHUNK - n, 3))]).reshape(chunks, CHUNK, 3)
    first = np.concatenate([first, np.ones(chunks * CHUNK - n, dtype=bool)]).reshape(chunks, CHUNK)

    def step(i: int) -> np.ndarray:
        """Score of entering each tag of token ``i`` of every chunk from each tag before it."""
        return np.where(first[:, i, None, None], begin[None, None, :], move[None]) + score[:, i, None, :]

    across = step(0)  # best from a tag before the chunk to a tag of its current token
    for i in range(1, CHUNK):
        across = (across[:, :, :, None] + step(i)[:, None, :, :]).max(axis=2)
    entry, at = np.zeros((chunks, 3)), np.zeros(3)
    for c in range(chunks):
        entry[c] = at
        at = (at[:, None] + across[c]).max(axis=0)
        at = at - at.max()
    back = np.zeros((CHUNK, chunks, 3), np.int8)
    for i in range(CHUNK):
        ways = entry[:, :, None] + step(i)
        back[i] = ways.argmax(axis=1)
        entry = ways.max(axis=1)
    leads = np.tile(np.arange(3, dtype=np.int8), (chunks, 1))  # tag before the chunk that each exit tag comes from
    for i in range(CHUNK - 1, -1, -1):
        leads = np.take_along_axis(back[i], leads.astype(np.int64), axis=1)
    tag = np.zeros(chunks, np.int64)
    tag[-1] = int(np.argmax(at))
    for c in range(chunks - 1, 0, -1):
        tag[c - 1] = leads[c, tag[c]]
    out = np.zeros((chunks, CHUNK), np.int8)
    for i in range(CHUNK - 1, -1, -1):
        out[:, i] = tag
        tag = back[i][np.arange(chunks), tag]
    return out.ravel()[:n]


def _labels(spans: list[list[tuple[int, int, int, int]]], offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Tags of the tokens by the finds of the patterns."""
    tags = np.zeros(len(start), np.int8)
    for base, found in zip(offsets.tolist(), spans, strict=False):
        for _, _, stop, secret in found:
            a, b = np.searchsorted(start, [base + secret, base + stop])
            if tags[a:b].any():
                continue
            tags[a:b] = INSIDE
            tags[a:a + 1] = BEGIN
    return tags


def _windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Training windows of a batch of texts: around each find, and one at a place given by the text's hash elsewhere."""
    for rows, data, offsets in bs.slices(batch):
        start, stop, count = tokens(data, offsets)
        raw = data.tobytes()
        spans = [base_spans(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        tags, places = _labels(spans, offsets, start), features(data, start, stop, count)
        ends = np.concatenate([[0], np.cumsum(count)])
        keys = rows.column("key").to_numpy()
        found, order, where, values = [], [], [], []
        for i in np.flatnonzero(count).tolist():
            low, high = int(ends[i]), int(ends[i + 1])
            begins = np.flatnonzero(tags[low:high] == BEGIN) + low
            wanted = begins - WINDOW // 2 if len(begins) else np.array([low + int(keys[i] % (high - low))])
            for w in np.clip(wanted, low, max(low, high - WINDOW)).tolist():
                if w + WINDOW <= high:
                    found.append(bool(len(begins)))
                    order.append(int(keys[i]) ^ w)
                    where.append(tags[w:w + WINDOW])
                    values.append(places[:, w:w + WINDOW].T.ravel())
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(order, pa.int64()), pa.array([w.tobytes() for w in where]), pa.array([v.tobytes() for v in values])],
                ["found", "place", "tags", "places"])


def train(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The field fitted on windows of ``texts`` (text), or None where the patterns find nothing to learn from.

    Looks at TRAIN_DOCUMENTS texts in expectation, chosen by hash, and fits on FOUND_WINDOWS and PLAIN_WINDOWS windows at most,
    in one task; the model's size is fixed.
    """
    share = TRAIN_DOCUMENTS / max(1, texts.count())
    sample = texts.select("text", F.pmod(F.xxhash64("text"), F.lit(2**62)).alias("key")).where(F.col("key") < int(min(1.0, share) * 2.0**62))
    windows = saved(arrow_map(sample, _windows, "found boolean, place bigint, tags binary, places binary"))
    if not windows.where("found").limit(1).count():
        return None
    some = windows.where("found").orderBy("place", "places").limit(FOUND_WINDOWS).unionByName(
        windows.where("NOT found").orderBy("place", "places").limit(PLAIN_WINDOWS))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("found", "descending"), ("place", "ascending"), ("places", "ascending")])
        tags = np.stack([np.frombuffer(t, np.int8) for t in table.column("tags").to_pylist()]).astype(np.int64)
        places = np.stack([np.frombuffer(p, np.int32) for p in table.column("places").to_pylist()]).reshape(len(tags), WINDOW, -1)
        hidden = places[::2].copy()
        hidden[:, :, list(CONTEXT)] = _FIRST[list(CONTEXT)]
        field = fit(np.concatenate([places, hidden]), np.concatenate([tags, tags[::2]]))
        return pa.table({"model": pa.array([[p.astype(np.float64).tobytes() for p in field]])})

    (row,) = some.groupBy().applyInArrow(solve, "model array<binary>").collect()
    table, move, begin = (np.frombuffer(p) for p in row["model"])
    return table.reshape(-1, 3).astype(np.float32), move.reshape(3, 3), begin


def tagged(data: np.ndarray, offsets: np.ndarray, field: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, in bytes, of the secrets that the field tags in the texts of a slice."""
    table, move, begin = field
    start, stop, count = tokens(data, offsets)
    score = np.zeros((len(start), 3), np.float32)
    for row in features(data, start, stop, count):
        score += table[row]
    first = np.zeros(len(start), dtype=bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    tags = decode(score, first, move, begin)
    fresh = (tags == BEGIN) | ((tags == INSIDE) & (first | (np.append(OUT, tags[:-1]) == OUT)))
    opens = np.flatnonzero(fresh)
    shut = (tags != OUT) & np.append(fresh[1:] | (tags[1:] == OUT), True)
    return start[opens], stop[np.flatnonzero(shut)]


def scan(docs: DataFrame, field: tuple | None = None) -> DataFrame:
    """Finds of each document: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans.

    One row for each row of ``docs``, null and empty texts with no finds. ``spans`` joins kind:start:end of all finds, by start and then
    kind, in code points with an exclusive end; ``base_sha256`` is the digest of those of the patterns alone. An assignment's span is
    its whole match. A secret of the field that overlaps a find of a pattern adds nothing; where the patterns find nothing in the
    sample there is no field. ``field`` is a model of ``train``, fitted on ``docs`` by default.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    field = train(rows) if field is None else field

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in bs.slices(batch):
            raw = data.tobytes()
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            more: list[list[tuple[int, int, int, int]]] = [[] for _ in range(part.num_rows)]
            if field is not None:
                for a, b in zip(*(x.tolist() for x in tagged(data, offsets, field)), strict=True):
                    i = int(np.searchsorted(offsets, a, side="right")) - 1
                    more[i].append((a - int(offsets[i]), 3, b - int(offsets[i]), a - int(offsets[i])))
            counts, digests, spans = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                base = base_spans(raw[a:b])
                added = [m for m in more[i] if not any(m[0] < f[2] and f[0] < m[2] for f in base)]
                named = lambda found: ",".join(
                    f"{KINDS[k]}:{points[a + s] - points[a]}:{points[a + e] - points[a]}" for s, k, e, _ in found)  # noqa: B023
                counts.append([sum(f[1] == kind for f in base + added) for kind in range(4)])
                digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                spans.append(named(sorted(base + added)))
            numbers = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests), pa.array(spans)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return arrow_map(rows, find, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string")
