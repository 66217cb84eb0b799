"""Language-model scoring by context-tree weighting.

A text is its words, each with a space after it, and one end byte. Each byte is eight binary decisions; each decision has
its own tree of contexts, the bytes before, the latest first. A node estimates a bit from its counts (Krichevsky-Trofimov)
and weights that half and half against what its children say, so all depths are mixed. After training the weights are
fixed: a bit's probability is its estimates along the path from the root, each with its node's posterior weight. A path
ends at the deepest node that training has seen, which takes the weight that is left.

The tree holds every context of up to `DEPTH` bytes that training has; it grows with the corpus and is never in one place.
Texts are dealt out to chunks by a hash. A chunk writes to each shard of the tree a letter, its distinct sequences of
DEPTH + 1 bytes with their training counts; shards are ranges of contexts. A shard adds up its letters, weights the
subtrees inside its range from the leaves up, and keeps one row. Nodes that hold several shards are few, at most DEPTH for
each border; their sums meet on the driver, and what they weigh goes back to the shards, which answer each letter with
the log probability of its sequences, to 1/4096. Counts of words, for the base score, go the same way, in shards by hash. Chunks read
the answers next to their texts. Borders are quantiles of a sample of sequences; they balance shards and change no result.

Null and empty texts are the end byte alone. Bytes never seen in training have a probability as well. Rows without an id
are learned from and scored as others; rows that repeat are each learned from and scored, and are dealt to one chunk.
Without training rows each bit has probability 1/2 and the base counts are 0. Only the columns named are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from math import log, log10, pi

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, batches_of, few_rows, remainder, table, written

DEPTH = 6
#: Bytes of text in a chunk, and for each shard, about.
CHUNK_BYTES, SHARD_BYTES = 6_000_000, 12_000_000
#: Bytes of text that borders are taken from, and sequences taken from these, about.
SAMPLE_BYTES, SAMPLE_GRAMS = 48_000_000, 400_000
#: Bytes of texts that a task sorts into parcels at once.
PARCEL_BYTES = 24_000_000
#: Positions looked at at once.
BLOCK = 8_000_000
#: Steps of a log10 probability in an answer: two bytes for each sequence.
STEPS = 4096
#: Bytes of weights of shared nodes that are broadcast at most.
FEW_BYTES = 32_000_000


def body(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def grams(bodies: list[bytes]) -> np.ndarray:
    """Of each byte its sequence as an integer: the DEPTH bytes before it, latest first, then the byte. A text starts after end bytes."""
    raw = b"".join(b"\n" * DEPTH + x for x in bodies)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(x) + DEPTH for x in bodies])
    starts = np.concatenate([[0], ends[:-1]])
    real = np.ones(len(data), bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    # Of each byte itself and the seven before it as an integer, latest first: the text backwards, read at every byte.
    back = np.ndarray(len(raw), ">u8", raw[::-1] + bytes(8), strides=(1,))[::-1]
    packed = back[:-1][real[1:]].astype(np.uint64)
    packed >>= np.uint64(64 - 8 * DEPTH)
    packed <<= np.uint64(8)
    packed |= data[1:][real[1:]]
    return packed


def blocks(bodies: list[bytes]):
    """(sequences, own) by blocks of some positions; own: by text its place in bodies and how many of the sequences are its own. A long text is cut, with its context."""
    group, size = [], 0
    for i, whole in enumerate(bodies):
        for k in range(0, len(whole), BLOCK):
            group.append((i, k))
            size += min(BLOCK, len(whole) - k)
            if size >= BLOCK:
                yield of_block(bodies, group)
                group, size = [], 0
    if group:
        yield of_block(bodies, group)


def of_block(bodies: list[bytes], group: list[tuple[int, int]]):
    parts, own = [], []
    for i, k in group:
        piece = bodies[i][max(0, k - DEPTH) : k + BLOCK]
        before = min(k, DEPTH)
        parts.append(grams([piece])[before:] if k else piece)
        own.append((i, len(piece) - before))
    # Texts that start here are packed in one go, the rest of cut texts one by one.
    found, waiting = [], []
    for p in parts:
        if isinstance(p, bytes):
            waiting.append(p)
        else:
            found += [grams(waiting)] if waiting else []
            waiting = []
            found.append(p)
    if waiting:
        found.append(grams(waiting))
    return np.concatenate(found), own


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys))


def counted(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs where learns is 1. Keys leave a byte free, whose last bit is used."""
    both = keys << np.uint64(1)
    both |= learns
    both.sort()
    all_ = both >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([all_[:1] == all_[:1], all_[1:] != all_[:-1]]))
    both &= np.uint64(1)
    return all_[starts], np.add.reduceat(both, starts).astype(np.uint32) if len(starts) else np.empty(0, np.uint32)


def by_key(keys: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and by position in the order of keys the place of its key among them and of its part; parts of these sizes stand one after another.

    Positions are dealt out by the first two bytes of a key; the rest and the part are sorted as one integer, which has room for the parts of a block.
    """
    rest = np.uint64(8 * (DEPTH + 1) - 16)
    own = np.uint64(64) - rest
    head = (keys >> rest).astype(np.uint16)
    ends = np.cumsum(np.bincount(head, minlength=1 << 16))
    both = keys << own
    both |= np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    both = both[np.argsort(head, kind="stable")]
    heads = np.flatnonzero(np.diff(ends, prepend=0))
    new, low = np.zeros(len(keys), bool), 0
    for high in ends[heads].tolist():
        both[low:high].sort()
        new[low], low = True, high
    rests = both >> own
    new[1:] |= rests[1:] != rests[:-1]
    starts = np.flatnonzero(new)
    all_ = (np.searchsorted(ends, starts, side="right").astype(np.uint64) << rest) | rests[starts]
    both &= (np.uint64(1) << own) - np.uint64(1)
    return all_, np.cumsum(new) - 1, both.astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """The values, whole numbers, compressed: their bytes, all first bytes first."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(wide, -1).T).view(kind).ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_sorted(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(raw, kind), dtype=kind)


# Log of gamma(k + 1/2) and of gamma(k + 1) for whole k.
SMALL = 1 << 16
LOG_HALF = np.concatenate([[0.5 * log(pi)], 0.5 * log(pi) + np.cumsum(np.log(np.arange(SMALL - 1) + 0.5))])
LOG_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, SMALL)))])


def log_gamma(whole: np.ndarray, add: float, small: np.ndarray) -> np.ndarray:
    """Log of gamma(whole + add); beyond the table by Stirling's series."""
    out = small[np.minimum(whole, SMALL - 1).astype(np.int64)]
    big = whole >= SMALL
    if big.any():
        x = whole[big] + add
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a, 0.5, LOG_HALF) + log_gamma(b, 0.5, LOG_HALF) - log_gamma(a + b, 1.0, LOG_WHOLE) - log(pi)


def weighed(a, b, below):
    """Log of the weighted probability of nodes with children, and the posterior weight of their own estimate."""
    n = a + b
    # One occurrence has probability 1/2 at each depth.
    both, weight = np.where(n == 1, -log(2), 0.0), np.full(len(n), 0.5)
    many = np.flatnonzero(n > 1)
    own = log_kt(a[many], b[many])
    both[many] = np.logaddexp(own, below[many]) - log(2)
    weight[many] = np.exp(np.clip(own - log(2) - both[many], -700, 0))
    return both, weight


def levels(keys: np.ndarray, n: np.ndarray) -> list[tuple]:
    """By depth of contexts (keys, counts, place of each key of the next depth): keys are contexts and the byte that follows."""
    out = [(keys, n.astype(np.float64), None)]
    for _ in range(DEPTH):
        deeper, counts, _ = out[-1]
        found, where = np.unique(((deeper >> np.uint64(16)) << np.uint64(8)) | (deeper & np.uint64(255)), return_inverse=True)
        out.append((found, np.bincount(where, counts, len(found)), where))
    return out[::-1]


def shared(contexts: np.ndarray, depth: int, low: int, high: int | None) -> np.ndarray:
    """Which contexts hold sequences on both sides of a border of the shard, low and high."""
    out, wide = np.zeros(len(contexts), bool), 8 * (DEPTH + 1 - depth)
    for border in (low, high):
        if border:
            holds = border >> wide if wide < 64 else 0
            if border != holds << wide:
                out |= contexts == np.uint64(holds)
    return out


def subtree(keys: np.ndarray, n: np.ndarray, low: int, high: int | None, top: dict | None = None):
    """What a shard says. Without top: rows (depth, context, slot, a, b, below) of nodes shared with other shards, whose sums make them whole.

    With top, by (depth, context, slot) (mixed, left, final): log10 probability of each key. A slot is a decision: 1 and the
    bits before it. keys with a count of 0 aren't seen but get a probability.
    """
    tree = levels(keys, n)
    rows, total = [], np.zeros(len(keys))
    for bit in range(8):
        nodes = []
        for d, (k, counts, _) in enumerate(tree):
            group = k >> np.uint64(8 - bit)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            of = np.zeros(len(k), np.int64)
            of[starts[1:]] = 1
            of = np.cumsum(of)
            ones = ((k >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
            all_, b = np.add.reduceat(counts, starts), np.add.reduceat(counts * ones, starts)
            first = k[starts]
            nodes.append((of, starts, all_ - b, b, shared(first >> np.uint64(8), d, low, high), first))
        parents = [None] + [nodes[d][0][tree[d][2][nodes[d + 1][1]]] for d in range(DEPTH)]
        weight = [None] * (DEPTH + 1)
        below = None
        for d in range(DEPTH, -1, -1):
            _, _, a, b, split, first = nodes[d]
            seen = a + b > 0
            if d == DEPTH:
                both, weight[d] = log_kt(a, b), np.ones(len(a))
            else:
                both, weight[d] = weighed(a, b, below)
            if top is None:
                for g in np.flatnonzero(split & seen):
                    slot = (1 << bit) + (int(first[g]) & 255) // (1 << (8 - bit))
                    rows.append((d, int(first[g]) >> 8, slot, a[g], b[g], below[g]))
            if d:
                below = np.bincount(parents[d], np.where(seen & ~split, both, 0.0), len(nodes[d - 1][1]))
        if top is None:
            continue
        mixed, left, final = np.zeros(1), np.ones(1), np.full(1, 0.5)
        for d in range(DEPTH + 1):
            _, _, a, b, split, first = nodes[d]
            if d:
                mixed, left, final = mixed[parents[d]], left[parents[d]], final[parents[d]]
            else:
                mixed, left, final = (np.repeat(x, len(a)) for x in (mixed, left, final))
            seen = a + b > 0
            estimate = (a + 0.5) / (a + b + 1)
            final = np.where(seen, mixed + left * estimate, final)
            mixed = np.where(seen, mixed + left * weight[d] * estimate, final)
            left = np.where(seen, left * (1 - weight[d]), 0.0)
            for g in np.flatnonzero(split):
                slot = (1 << bit) + (int(first[g]) & 255) // (1 << (8 - bit))
                # A node that isn't there no shard has seen: it says what its parent says.
                mixed[g], left[g], final[g] = top.get((d, int(first[g]) >> 8, slot), (final[g], 0.0, final[g]))
        of = nodes[DEPTH][0]
        zero = np.clip(final, 1e-12, 1 - 1e-12)[of]
        ones = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(ones, 1 - zero, zero))
    return rows if top is None else total


def join_top(rows) -> dict:
    """By (depth, context, slot) the values (mixed, left, final) of shared nodes; rows: (depth, context, slot, a, b, below) summed over shards."""
    nodes = {(d, c, s): [a, b, below] for d, c, s, a, b, below in rows}
    weight = {}
    for d, c, s in sorted(nodes, reverse=True):
        a, b, below = nodes[d, c, s]
        both, w = weighed(np.array([a]), np.array([b]), np.array([below]))
        weight[d, c, s] = float(w[0])
        if d:
            nodes[d - 1, c >> 8, s][2] += float(both[0])
    out = {}
    for d, c, s in sorted(nodes):
        a, b, _ = nodes[d, c, s]
        mixed, left, _ = out[d - 1, c >> 8, s] if d else (0.0, 1.0, 0.5)
        w, estimate = weight[d, c, s], (a + 0.5) / (a + b + 1)
        out[d, c, s] = (mixed + left * w * estimate, left * (1 - w), mixed + left * estimate)
    return out


def words_by_shard(words, shards: int) -> dict[int, list[bytes]]:
    """Different words by their shard, sorted; shards of words are numbered from -1 down."""
    lists, digest = [[] for _ in range(shards)], xxhash.xxh3_64_intdigest
    for w in words:
        lists[digest(w) % shards].append(w)
    return {-1 - k: sorted(some) for k, some in enumerate(lists) if some}


def bundled(rows: DataFrame) -> DataFrame:
    """(chunk, rows): the rows of each chunk in parcels, compressed. rows: key, text, learns, chunk."""

    def run(batches):
        waiting, size = [], 0

        def parcels():
            table_ = pa.Table.from_batches(waiting).combine_chunks()
            chunks = table_.column("chunk").to_numpy()
            order = np.argsort(chunks, kind="stable")
            table_ = table_.take(pa.array(order)).drop_columns(["chunk"])
            starts = np.flatnonzero(np.concatenate([[True], np.diff(chunks[order]) != 0]))
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table_.schema) as stream:
                    stream.write_table(table_.slice(lo, hi - lo))
                out.append((int(chunks[order[lo]]), zstandard.compress(sink.getvalue().to_pybytes(), 1)))
            names, raw = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"chunk": pa.array(names, pa.int64()), "rows": pa.array(raw, pa.binary())})

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
            if size >= PARCEL_BYTES:
                yield parcels()
                waiting, size = [], 0
        if waiting:
            yield parcels()

    return rows.transform(few_rows).mapInArrow(run, "chunk long, rows binary")


def opened(parcels: pa.Table) -> pa.Table:
    """The rows of a chunk's parcels."""
    raw = parcels.column("rows").to_pylist()
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(r)).read_all() for r in raw]) if raw else pa.table({"key": [], "text": [], "learns": []})


def texts_of(batch) -> list[list[bytes]]:
    return [ascii_words(t) for t in batch.column("text").to_pylist()]


def letters(cuts: np.ndarray, word_shards: int):
    """A chunk's letters: (shard, chunk, keys, n)."""

    def write(key, rows):
        at, chunk = key[0].as_py(), opened(rows)
        words, learns = texts_of(chunk), chunk.column("learns").to_pylist()
        bodies = [body(w) for w in words]
        keys, n = np.empty(0, np.uint64), np.empty(0, np.uint32)
        for some, own in blocks(bodies):
            found, times = counted(some, np.repeat(np.array([learns[i] for i, _ in own], np.uint8), [k for _, k in own]))
            if not len(keys):
                keys, n = found, times
                continue
            all_, _ = distinct(np.sort(np.concatenate([found, keys])))
            counts = np.zeros(len(all_), np.uint32)
            counts[np.searchsorted(all_, keys)] = n
            counts[np.searchsorted(all_, found)] += times
            keys, n = all_, counts
        out, ends = [], [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
        for shard, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if hi > lo:
                out.append((shard, at, packed_sorted(keys[lo:hi]), packed(n[lo:hi])))
        times = word_counts(words, learns)
        for shard, some in words_by_shard(times, word_shards).items():
            out.append((shard, at, zstandard.compress(b" ".join(some), 1), packed(np.array([times[w] for w in some], np.uint32))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["shard", "chunk", "keys", "n"])

    return write


def word_counts(words: list[list[bytes]], learns: list[bool]) -> dict:
    """Training counts of all words, 0 for those that stand in other texts only."""
    found, others = Counter(), set()
    for w, learn in zip(words, learns, strict=True):
        if learn:
            found.update(w)
        else:
            others.update(w)
    return dict.fromkeys(others, 0) | found


KEPT = "kind string, shard long, chunk long, depth int, context long, slot int, a double, b double, below double, keys binary, n binary, chunks array<long>, sizes array<long>, places binary"
KEPT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
KEPT_NAMES = [c.split(" ")[0] for c in KEPT.split(", ")]


def merged(cuts: np.ndarray):
    """A shard: its one row with sums and the places of its letters in them, and rows of shared nodes; a shard of words answers at once."""

    def add_up(key, found):
        shard = key[0].as_py()
        chunks, keys, counts = (found.column(c).to_pylist() for c in ("chunk", "keys", "n"))
        rows = []
        put = lambda kind, **values: rows.append(tuple({"kind": kind, "shard": shard, **values}.get(c) for c in KEPT_NAMES))
        if shard < 0:
            total = Counter()
            names = [zstandard.decompress(k).split(b" ") for k in keys]
            for some, n in zip(names, counts, strict=True):
                for w, c in zip(some, unpacked(n, np.uint32).tolist(), strict=True):
                    total[w] += c
            for chunk, some in zip(chunks, names, strict=True):
                put("answer", chunk=chunk, places=packed(np.array([total[w] for w in some], np.int64)))
            put("sums", a=float(sum(total.values())), b=float(sum(c > 0 for c in total.values())))
        else:
            parts = [unpacked_sorted(k, np.uint64) for k in keys]
            all_, places = np.unique(np.concatenate(parts), return_inverse=True)
            n = np.bincount(places, np.concatenate([unpacked(c, np.uint32) for c in counts]), len(all_)).astype(np.int64)
            sizes, places = [len(p) for p in parts], places.astype(np.int32)
            del keys, counts, parts
            low, high = int(cuts[shard - 1]) if shard else 0, int(cuts[shard]) if shard < len(cuts) else None
            put("shard", keys=packed_sorted(all_), n=packed(n), chunks=chunks, sizes=sizes, places=packed(np.diff(places, prepend=np.int32(0))))
            del places
            for d, c, s, a, b, below in subtree(all_, n, low, high):
                put("shared", depth=d, context=c, slot=s, a=a, b=b, below=below)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KEPT_TYPES, strict=True)], names=KEPT_NAMES)

    return add_up


def around(low: int, high: int | None) -> set:
    """The nodes that a shard may share with others, as (depth, context): those of the contexts at its borders."""
    return {(d, border >> 8 * (DEPTH + 1 - d) if d else 0) for border in (low, high) if border for d in range(DEPTH + 1)}


def answers(shards: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(shard, chunk, answer) of shards' rows with top, the values of their shared nodes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, keys, n, places, top = (row.column(row.schema.get_field_index(c))[0].as_py() for c in ("shard", "keys", "n", "places", "top"))
                chunks, sizes = (row.column(row.schema.get_field_index(c))[0].as_py() for c in ("chunks", "sizes"))
                low, high = int(cuts[shard - 1]) if shard else 0, int(cuts[shard]) if shard < len(cuts) else None
                known = {(d, c, s): (m, x, f) for d, c, s, m, x, f in zip(*([top[k] for k in ("depth", "context", "slot", "mixed", "left", "final")] if top else [[]] * 6), strict=True)}
                scores = subtree(unpacked_sorted(keys, np.uint64), unpacked(n, np.int64), low, high, known)
                scores = np.minimum(np.rint(-scores * STEPS), 65535).astype(np.uint16)[unpacked_sorted(places, np.int32)]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(0, len(chunks), 64):
                    said = [packed(scores[ends[j] : ends[j + 1]]) for j in range(k, min(k + 64, len(chunks)))]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(said), pa.int64()), "chunk": pa.array(chunks[k : k + 64], pa.int64()), "answer": pa.array(said, pa.binary())})

    return shards.mapInArrow(run, "shard long, chunk long, answer binary")


def scored(word_shards: int, key: str, kind):
    """Scores of a chunk's texts, from the answers to its letters."""

    def read(_, rows, said):
        chunk = opened(rows)
        if not chunk.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in [kind, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]], names=[key, "n_tokens", "n_known", "base_score", "score", "n_bytes"])
        words = texts_of(chunk)
        bodies = [body(w) for w in words]
        by_shard = dict(zip(said.column("shard").to_pylist(), said.column("answer").to_pylist(), strict=True))
        logs = np.concatenate([np.empty(0, np.uint16), *[unpacked(by_shard[s], np.uint16) for s in sorted(by_shard) if s >= 0]])
        gain = {}
        for shard, some in words_by_shard(set().union(*words), word_shards).items():
            gain.update(zip(some, np.log10(unpacked(by_shard[shard], np.int64) + 1).tolist(), strict=True))
        found = [(*by_key(some, [k for _, k in own]), own) for some, own in blocks(bodies)]
        keys = distinct(np.sort(np.concatenate([f[0] for f in found])))[0] if len(found) > 1 else found[0][0]
        scores = np.zeros(len(words), np.int64)
        for own_keys, of, part, own in found:
            each = logs[np.searchsorted(keys, own_keys)] if len(found) > 1 else logs
            # Steps are whole numbers, whose sums doubles hold exactly.
            np.add.at(scores, [i for i, _ in own], np.bincount(part, each[of], len(own)).astype(np.int64))
        base, known = [], []
        for w in words:
            gains = list(map(gain.__getitem__, w))
            base.append(sum(gains))
            known.append(len(gains) - gains.count(0.0))
        return pa.Table.from_arrays(
            [chunk.column("key").cast(kind), pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(-scores / STEPS), pa.array([len(b) for b in bodies], pa.int64())],
            names=[key, "n_tokens", "n_known", "base_score", "score", "n_bytes"],
        )

    return read


def borders(rows: DataFrame, size: int) -> np.ndarray:
    """Borders of shards: contexts' first sequences. rows: (key, text)."""
    shards = -(-size // SHARD_BYTES)
    if shards < 2:
        return np.empty(0, np.uint64)
    share = min(1.0, SAMPLE_BYTES / size)
    every = max(1, int(size * share) // SAMPLE_GRAMS)

    def run(batches):
        for (texts,) in batches_of(batches, ["text"]):
            for keys, _ in blocks([body(ascii_words(t)) for t in texts]):
                keys = distinct(np.sort(keys))[0]
                picked = keys[(keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(every) == 0]
                yield pa.RecordBatch.from_pydict({"gram": picked.view(np.int64)})

    sample = rows.where(F.pmod(F.xxhash64("key", "text", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    found = np.sort(sample.select("text").transform(few_rows).mapInArrow(run, "gram long").toPandas()["gram"].to_numpy().view(np.uint64))
    if not len(found):
        return np.empty(0, np.uint64)
    chosen = found[(np.arange(1, shards) * len(found)) // shards]
    return np.setdiff1d(chosen & ~np.uint64(255), np.zeros(1, np.uint64))


def score(docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, n_bytes, bits_per_byte, train_tokens) of each row, by a model of the rows where learns holds."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    size, ends = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 2), F.sum(F.col("learns").cast("long"))).first()
    size, ends, name = size or 0, ends or 0, f"ctw-{uuid.uuid4().hex}"
    cuts = borders(rows, size)
    chunks, word_shards = -(-size // CHUNK_BYTES) or 1, len(cuts) + 1
    dealt = bundled(rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks))))
    sent = dealt.groupBy("chunk").applyInArrow(letters(cuts, word_shards), "shard long, chunk long, keys binary, n binary")
    kept = written(sent.groupBy("shard").applyInArrow(merged(cuts), KEPT).transform(few_rows), f"{name}/shards")
    sums = kept.where("kind = 'sums'").agg(F.sum("a"), F.sum("b")).first()
    tokens, distinct = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)
    shared_rows = kept.where("kind = 'shared'").groupBy("depth", "context", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toPandas()
    top = join_top(shared_rows.itertuples(index=False))
    shards = kept.where("kind = 'shard'").select("shard", "keys", "n", "chunks", "sizes", "places")
    said = answers(with_top(shards, top, cuts), cuts).unionByName(kept.where("kind = 'answer'").select("shard", "chunk", F.col("places").alias("answer")))
    kind = docs.select(key).schema[key].dataType
    arrow = docs.select(key).limit(0).toArrow().schema.field(key).type
    found = dealt.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(scored(word_shards, key, arrow), f"`{key}` {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    below = log10(tokens + distinct + 1) if tokens else 0.0
    base = F.col("base_score") + log10(ends + 1) - F.col("n_tokens") * below
    return found.select(
        key, "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), base.alias("base_score"), "score", "n_bytes",
        (-F.col("score") * (log(10) / log(2)) / F.col("n_bytes")).alias("bits_per_byte"), F.lit(tokens).cast("long").alias("train_tokens"),
    )


def with_top(shards: DataFrame, top: dict, cuts: np.ndarray) -> DataFrame:
    """shards with top: the values of the nodes that each shares with others; broadcast while they are few."""
    kind = "shard long, top struct<depth array<int>, context array<long>, slot array<int>, mixed array<double>, left array<double>, final array<double>>"
    by_node = {}
    for (d, c, s), values in top.items():
        by_node.setdefault((d, c), []).append((d, c, s, *values))
    rows, n = [], 0
    for shard in range(len(cuts) + 1):
        low, high = int(cuts[shard - 1]) if shard else 0, int(cuts[shard]) if shard < len(cuts) else None
        own = [x for node in sorted(around(low, high)) for x in by_node.get(node, [])]
        n += len(own)
        rows.append((shard, tuple(map(list, zip(*own, strict=True))) if own else None))
    known = shards.sparkSession.createDataFrame(rows, kind)
    return shards.join(F.broadcast(known) if n * 40 <= FEW_BYTES else known, "shard")


def op1_ctw(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return score(docs, ~held_out).withColumn("held_out", held_out)
