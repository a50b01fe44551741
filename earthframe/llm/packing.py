"""Packing documents into token sequences by order-preserving dynamic programming.

The token stream of a partition's documents, in their order, is cut into windows of at most 1,024 tokens. Cuts
fall on document ends, sentence ends and, inside long sentences, every 32 tokens. With cost(j) the least cost of
cutting before place j,

    cost(j) = penalty(j) + min over i of cost(i) + padding(j - i),

where padding is 1,024 minus the length, or nothing at a power of two, and each sequence costs a little besides. ``cost(i) + i`` over the last 1,024 places
is a sliding minimum, kept in a monotone queue, so each place costs constant time. A stretch of the stream is
settled as soon as it is long enough, and what follows its last full window goes on to the next, so a task
holds a bounded piece of its partition. The end of a partition, less than one window, may be cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 1024
#: Tokens of padding that one cut inside a document is worth: at a sentence end, inside a sentence.
SENTENCE_CUT, INNER_CUT = 2, 12
#: What each sequence costs besides, so that full ones win over many short ones.
SEQUENCE = 8
#: Lengths short of a full sequence that are tried for their own sake, as they need no padding.
POWERS = (128, 256, 512)
INNER_EVERY = 32
#: Tokens settled at once.
STRETCH = 1 << 18
#: Words whose ids a task remembers.
REMEMBERED = 300_000
TOKENIZER = "byte_bpe_50k.json"
#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


class Encoder(dict):
    """Token ids of the byte-level BPE file at ``path``; maps a word to the ids of a space and the word.

    Single spaces between other characters always start a new token, so a text is looked up word by word;
    what a lookup misses is encoded by merge ranks read from the file. Texts with other runs of white space go
    through the merges whole, and texts that hold a special token's string go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = [t["content"] for t in vocabulary["added_tokens"]]
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary["model"]["vocab"].items()
                 if token not in self.special}
        self.merges = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.own = path, None
        size = 1 + max(*vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary["added_tokens"]))
        self.ends = np.zeros(size, bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.strip()[-1:] in (b".", b"!", b"?") or b"\n" in token

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.merges.encode_ordinary(" " + word)).tobytes()
        return ids

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            self.own = self.own or Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        if _OTHER_SPACE.search(text) or any(s in text for s in ("  ", " \n", "\n ")) or text[:1] == " " or text[-1:] == " ":
            return np.array(self.merges.encode_ordinary(text), "<u4")
        first, *rest = text.split(" ")
        start = np.array(self.merges.encode_ordinary(first), "<u4").tobytes()
        return np.frombuffer(start + b"".join(map(self.__getitem__, rest)), "<u4")


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The chosen places, 0 and the last included; neighbours in ``places`` are at most ``length`` apart."""
    exact: dict[int, list[int]] = {}
    for power in (p for p in POWERS if p < length):
        at = np.searchsorted(places, places - power)
        for k in np.flatnonzero(places[at] == places - power).tolist():
            exact.setdefault(k, []).append(int(at[k]))
    at, penalty = places.tolist(), (penalties + SEQUENCE).tolist()
    cost, back = [0] * len(at), [0] * len(at)
    keys, origins, head = [0], [0], 0  # cost(i) + i and number of i, smallest first, from ``head`` on
    for k in range(1, len(at)):
        j = at[k]
        while at[origins[head]] < j - length:
            head += 1
        least, origin = keys[head] + length - j, origins[head]
        if k in exact:
            for i in exact[k]:
                if cost[i] < least:
                    least, origin = cost[i], i
        least += penalty[k]
        cost[k], back[k] = least, origin
        key = least + j
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            origins.pop()
        keys.append(key)
        origins.append(k)
    chosen, k = [at[-1]], len(at) - 1
    while k:
        k = back[k]
        chosen.append(at[k])
    return chosen[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut and what a cut there costs; ``ends`` are the document ends."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[1:][sentence[ids]] = 2
    kind[ends] = 3
    kind[0] = 3
    firm = np.flatnonzero(kind)
    gap = np.diff(np.concatenate([firm, [len(ids)]]))
    for start, size in zip(firm[gap > INNER_EVERY].tolist(), gap[gap > INNER_EVERY].tolist(), strict=True):
        kind[start + INNER_EVERY:start + size:INNER_EVERY] = 1
    kind[len(ids)] = kind[len(ids)] or 1
    places = np.flatnonzero(kind)
    cost = np.array([0, INNER_CUT, SENTENCE_CUT, 0])[kind[places]]
    return places, cost


def _remainder(n: int) -> list[int]:
    """Lengths for a last stretch of ``n`` tokens, LENGTH at most: one padded sequence, or powers of two without padding."""
    bits = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return bits if (len(bits) - 1) * INNER_CUT <= LENGTH - n else [n]


def _packer(length_schema: pa.Schema, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path or public_tokenizers.path(TOKENIZER))
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, ids before, ids, tokens of the document), in order
        count = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, sequence
            ids = np.concatenate([h[2] for h in held]) if held else np.zeros(0, "<u4")
            bounds = np.concatenate([[0], np.cumsum([len(h[2]) for h in held])]).astype(int)
            whole = [h[1] + len(h[2]) == h[3] for h in held]
            places, cost = cut_places(ids, bounds[1:][np.array(whole, bool)] if held else bounds[:0], encoder.ends)
            chosen = best_cuts(places, cost)
            if last:
                chosen[-1:] = (chosen[-2] + np.cumsum(_remainder(chosen[-1] - chosen[-2]))).tolist()
            stop = chosen[-1] if last else chosen[-2]
            columns: list[list] = [[] for _ in length_schema]
            piece = 0
            for a, b in zip(chosen[:-1], chosen[1:], strict=True):
                if b > stop:
                    break
                while piece < len(held) and bounds[piece] < b:
                    lo, hi = max(a, bounds[piece]), min(b, bounds[piece + 1])
                    doc, before, own, tokens = held[piece]
                    cut = own[lo - bounds[piece]:hi - bounds[piece]]
                    for column, value in zip(columns, (doc, before + lo - bounds[piece], hi - lo, zlib.crc32(cut.tobytes()),
                                                       tokens, sequence, lo - a), strict=True):
                        column.append(value)
                    if bounds[piece + 1] > b:
                        break
                    piece += 1
                sequence += 1
            rest = []
            for k in range(len(held)):
                if bounds[k + 1] > stop:
                    skip = max(0, stop - bounds[k])
                    rest.append((held[k][0], held[k][1] + skip, held[k][2][skip:], held[k][3]))
            held, count = rest, int(bounds[-1]) - stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, length_schema, strict=True)], schema=length_schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(doc_ids, batch.column("text"), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                held.append((doc, 0, ids, len(ids)))
                count += len(ids)
                if count >= STRETCH:
                    yield from settle(last=False)
        if held:
            yield from settle(last=True)

    return run


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file on every executor; by default that of the installed package.
    A document is its ids and one id 0, so null and empty texts are one token. Rows are packed in the order and in the
    partitions in which Spark reads them, without a shuffle: a sequence never holds rows of two
    partitions. Rows that repeat a doc_id, or have none, are packed as documents of their own. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(_PIECES, tokenizer), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                                        "doc_tokens bigint, sequence_id bigint, offset bigint")
