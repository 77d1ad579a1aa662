"""Best-fit packing: a configuration linear program over the length histogram.

Documents are token ids plus one closing id 0; longer ones are cut into full pieces, the
first of which may be shorter.  Only the histogram of piece lengths (``MAX_TOKENS`` bins)
reaches the driver.  There a configuration (a multiset of lengths that fits a sequence)
is priced by an unbounded-knapsack dynamic program under multiplicative weights; the
fractional solution is rounded, and what is left is filled best fit, again by
configurations with counts, so that the work depends on the number of lengths and not on
the number of documents.  Pieces then get dense numbers within their length (hash
buckets and offsets) from which sequence and offset follow by arithmetic.

Token ids: the vocabulary and merges of the given tokenizer file, run by the tiktoken
engine, which gives the same ids several times faster; a text that contains the string of
a special token, or more than ``SAFE_SPACE`` white-space characters in a row (on which that
engine dies), goes through the tokenizers library.

Defined cases: a null or empty text is the single id 0; very long texts are read whole and
cut into pieces; repeated rows and identifiers are separate pieces; a null identifier is kept; an empty table gives
an empty result; other columns pass by.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_numbers, materialize

MAX_TOKENS = 2048
#: Share of a sequence that a configuration of the program may leave empty.
SLACK = 1 / 1024
#: Shares of the fractional solution that rounding tries; the fewest sequences win.
SCALES = (1.0, 0.95, 0.8, 0.5, 0.2)
#: White space in a row beyond which the fast engine's patterns may overflow their stack.
SAFE_SPACE = 50_000
_SPACES = re.compile(r"\s+")
#: Rows of one length that are numbered together.
BUCKET_ROWS = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def longest_space(text: str) -> int:
    """Length of the longest run of white space; 0 for texts too short for a long one."""
    if len(text) <= SAFE_SPACE:
        return 0
    return max((m.end() - m.start() for m in _SPACES.finditer(text)), default=0)


class Encoder:
    """Ids of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in printable}
        code |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or longest_space(text) > SAFE_SPACE:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process: it outlives a task, however many partitions there are."""
    return Encoder(path)


def piece_starts(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Starts of the pieces of ``n`` ids: all full but the first, which may be shorter."""
    first = n % most or most
    return [0, *range(first, n, most)]


def pieces(docs: DataFrame, tokenizer: str | None = None, most: int = MAX_TOKENS, emit_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * emit_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1)):
                    all_ids = np.append(enc.ids(t.as_py() or ""), np.uint32(0)).astype("<u4")
                    starts = piece_starts(len(all_ids), most)
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(all_ids)])):
                        doc.append(d), piece.append(k), start.append(s), length.append(e - s)
                        crc.append(zlib.crc32(all_ids[s:e].tobytes()))
                        if emit_ids:
                            ids.append(all_ids[s:e].astype(np.int32))
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * emit_ids, names + ["ids"] * emit_ids)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the linear program


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value per capacity and the last length taken (0: none).

    ``values[l]`` is the price of length ``l``; index 0 is unused.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        if k:
            got = best[c - lengths[:k]] + worth[:k]
            j = int(got.argmax())
            if got[j] > best[c - 1]:
                best[c], last[c] = got[j], lengths[j]
                continue
        best[c], last[c] = best[c - 1], 0
    return best, last


def _trace(last: np.ndarray, capacity: int) -> dict[int, int]:
    config: dict[int, int] = {}
    while capacity > 0:
        if not last[capacity]:
            capacity -= 1
            continue
        length = int(last[capacity])
        config[length] = config.get(length, 0) + 1
        capacity -= length
    return config


def fractional(counts: np.ndarray, capacity: int, rounds: int = 500, columns: int = 48, eta: float = 12.0, step: float = 0.02, near: float = 0.002) -> dict[tuple, float]:
    """Configurations and how often each is used, by multiplicative weights.

    The price of a length starts at its share of a sequence and falls by ``exp(-eta *
    covered share)`` against the mean, so lengths are covered at one pace.  A pricing
    gives the best configuration for each last length; those within ``near`` of the best
    value (``columns`` at most) are used for ``step`` of their scarcest length.  The
    result is scaled so that no length is used more often than it is there.
    """
    use: dict[tuple, float] = {}
    there = np.flatnonzero(counts)
    if not there.size:
        return use
    total, covered, weight = counts.astype(float), np.zeros(capacity + 1), counts[there] * there
    for _ in range(rounds):
        share = covered[there] / total[there]
        mean = float((share * weight).sum() / weight.sum())
        if mean >= 1:
            break
        prices = np.zeros(capacity + 1)
        prices[there] = there / capacity * np.exp(-eta * np.clip(share - mean, -2, 2))
        best, last = price(prices, capacity)
        worth = best[capacity - there] + prices[there]
        order = np.argsort(-worth, kind="stable")[:columns]
        for length in there[order[worth[order] >= (1 - near) * worth[order[0]]]]:
            config = _trace(last, capacity - int(length))
            config[int(length)] = config.get(int(length), 0) + 1
            own = np.array(list(config.items()))
            amount = step * float((total[own[:, 0]] / own[:, 1]).min())
            covered[own[:, 0]] += amount * own[:, 1]
            key = tuple(sorted(config.items(), reverse=True))
            use[key] = use.get(key, 0.0) + amount
    most = float((covered[there] / total[there]).max())
    return {k: x / max(1.0, most) for k, x in use.items()}


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Configurations for all that is left: largest first, gaps by the largest that fits."""
    out, left = [], left.copy()
    while (open_ := np.flatnonzero(left)).size:
        gap, config = capacity, {}
        while gap > 0 and (k := int(np.searchsorted(open_, gap, side="right"))):
            length = int(open_[k - 1])
            room = left[length] - config.get(length, 0)
            if room <= 0:
                open_ = np.delete(open_, k - 1)
                continue
            take = int(min(gap // length, room))
            # Take one at a time unless the rest is filled by the same length.
            config[length] = config.get(length, 0) + take
            gap -= take * length
        times = int(min(left[n] // c for n, c in config.items()))
        for n, c in config.items():
            left[n] -= times * c
        out.append((tuple(sorted(config.items(), reverse=True)), times))
    return out


def rounded(use: dict[tuple, float], counts: np.ndarray, capacity: int, scale: float) -> list[tuple[tuple, int]]:
    """Whole numbers of each configuration, ``scale`` of the fractional ones, best fit for the rest."""
    left, out = counts.copy(), []
    for config, x in sorted(use.items(), key=lambda u: (-u[1], u[0])):
        if capacity - sum(n * c for n, c in config) > capacity * SLACK:
            continue  # its pieces fit better where more lengths are open
        times = min(int(x * scale + 1e-6), *(int(left[n] // c) for n, c in config))
        if times > 0:
            for n, c in config:
                left[n] -= times * c
            out.append((config, times))
    return out + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int = MAX_TOKENS) -> list[tuple[tuple, int]]:
    """(configuration, times) that use every counted piece exactly once."""
    left, full = counts.astype(np.int64).copy(), []
    if left[capacity]:
        full.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    use = fractional(left, capacity)
    tried = (rounded(use, left, capacity, scale) for scale in SCALES)
    return full + min(tried, key=lambda p: sum(t for _, t in p))


def assignment(planned: list[tuple[tuple, int]], capacity: int = MAX_TOKENS) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies per sequence, first sequence, first offset)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, times in planned:
        offset = 0
        for length, copies in config:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, copies, sequence, offset))
            used[length] = rank + copies * times
            offset += copies * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = MAX_TOKENS, emit_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset (place in the sequence)."""
    cut = materialize(pieces(docs, tokenizer, most, emit_ids, id_col, text_col))
    counts = np.zeros(most + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``most`` rows
        counts[r["length"]] = r["count"]
    where = docs.sparkSession.sparkContext.broadcast(assignment(plan(counts, most), most))
    per_length = F.array(*[F.lit(int(max(1, -(-c // BUCKET_ROWS)))) for c in counts[1:]])
    ranked = dense_numbers(cut, "rank", F.element_at(per_length, F.col("length").cast("int")), within=["length"], order=["doc_id", "piece", "ids_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, spans = np.flatnonzero(length == n), where.value[int(n)]
                s = spans[np.searchsorted(spans[:, 0], rank[rows], side="right") - 1]
                k = rank[rows] - s[:, 0]
                seq[rows], off[rows] = s[:, 2] + k // s[:, 1], s[:, 3] + k % s[:, 1] * n
            keep = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    names = cut.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
