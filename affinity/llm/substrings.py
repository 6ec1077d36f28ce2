"""Substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. Each window is routed by its anchor, the ``ANCHOR``-word gram with
the smallest hash inside it; consecutive windows with one anchor form a segment. Equal windows have equal
anchors, so a shard that holds all segments of an anchor sees every repeat of its windows.

1. Anchors that occur in two documents or more are found by a shuffle of their hashes. Segments of other
   anchors cannot repeat and go no further.
2. The remaining segments are streamed to the shard of their anchor. A task sends each distinct segment
   once, with the smallest document that holds it; the other holders repeat all of it, so their verdict
   is known at once. An anchor or a line of a third of all documents is thus one row a task.
3. Each shard builds an FM-index (wavelet tree over the BWT) of its segments and streams them through a
   backward search; windows that occur elsewhere yield a suffix interval, and the smallest document in
   the interval tells whether the window starts in an earlier document.
4. Word ranges to remove go back to their documents.

Words are told apart by 64-bit hashes. Results in odd cases: null and empty texts have no words; texts
shorter than a window lose nothing; rows that share a doc_id are never compared with each other, each
keeps its own ranges; a null doc_id loses nothing and causes no loss; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.fmindex import FMIndex, matches
from affinity.llm.textops import gram_hash, mix, random_words, runs, slices, span_hash, utf8, words
from affinity.session import cut_lineage

WINDOW, ANCHOR = 13, 5
BROADCAST_BYTES = 32 << 20  # ranges up to this size are broadcast; beyond it the documents are shuffled to them
BUCKETS = 4096  # of anchors, at least; more with the number of shuffle partitions
CHUNK_BYTES = 16 << 20  # text in which a task looks for its own repeats
_WORD_UP = np.uint64(0x9E3779B97F4A7C15)


def _segments(h: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window start (word numbers within the slice) and anchor hash of each segment."""
    n = np.diff(at)
    many = np.maximum(n - window + 1, 0)
    starts = np.repeat(at[:-1], many) + runs(many)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    row = np.repeat(np.arange(len(n)), many)
    grams = gram_hash(h, anchor)
    width = window - anchor + 1
    low = grams.copy()
    reach = 1
    while reach < width:  # doubling: low[i] is the least of grams[i : i + reach]
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    low = low[starts]
    place = np.zeros(len(starts), np.int64)
    for d in range(width - 1, -1, -1):
        place = np.where(grams[starts + d] == low, d, place)
    place += starts
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return row[new], starts[new], starts[last], mix(low[new])


def _sequence_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Hash of the word sequences h[start:end], none longer than ``most``."""
    out = np.zeros(len(starts), np.uint64)
    n = ends - starts
    for j in range(most):
        on = n > j
        out[on] = (out[on] ^ h[starts[on] + j]) * _WORD_UP
        out[on] ^= out[on] >> np.uint64(29)
    return mix(out + n.astype(np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += len(utf8(b.column("text"))[0])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _binary(values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """Binary column of the runs of ``values`` (``width`` bytes each) between the cuts."""
    raw = np.ascontiguousarray(values).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(raw)])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


_ANCHOR_ROWS = "bucket int, hash binary, doc binary, place binary"


def _send_anchors(window: int, anchor: int, buckets: int) -> Callable:
    """Rows of (bucket, 32 more bits of each hash, doc, place). A hash met in two documents of the chunk is sent once with
    place -1; its segments are known to repeat and travel as rows without hashes, spread over the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, docs, places = [], [], []
            for b in chunk:
                data, offs = utf8(b.column("text"))
                s, e, at = words(data, offs)
                row, first, _, a = _segments(span_hash(data, s, e), at, window, anchor)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                hashes.append(a)
                docs.append(ids[row])
                places.append((first - at[row]).astype(np.int32))
            h, d, p = map(np.concatenate, (hashes, docs, places))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            cut = _groups(h[order])
            ds = d[order]
            many = np.repeat(np.minimum.reduceat(ds, cut[:-1]) != np.maximum.reduceat(ds, cut[:-1]), np.diff(cut))
            repeated = np.zeros(len(h), bool)
            repeated[order] = many
            head = np.zeros(len(h), bool)
            head[order[cut[:-1]]] = True
            send = ~repeated | head
            bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
            spread = np.where(send, bucket, d % buckets)
            for rows, own in ((np.flatnonzero(send), True), (np.flatnonzero(repeated), False)):
                if not len(rows):
                    continue
                rows = rows[np.argsort(spread[rows] if own else (d[rows] % buckets), kind="stable")]
                b = bucket[rows] if own else d[rows] % buckets
                cut = _groups(b)
                place = np.where(repeated[rows], -1, p[rows]).astype(np.int32) if own else p[rows]
                key = h[rows].astype(np.uint32) if own else np.zeros(0, np.uint32)
                ids = d[rows]
                if ids.min() >= 0 and ids.max() < 1 << 32:
                    ids = ids.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b[cut[:-1]].astype(np.int32)),
                        _binary(key, cut if own else np.zeros(len(cut), np.int64), 4),
                        _binary(ids, cut, ids.itemsize),
                        _binary(place, cut, 4),
                    ],
                    ["bucket", "hash", "doc", "place"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, places) of the segments whose anchor occurs in two documents; rows come sorted by bucket."""

    def verdict(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        docs, places = [], []
        hashes, own_d, own_p = [], [], []
        for key, doc, place in rows:
            p = np.frombuffer(place, np.int32)
            d = np.frombuffer(doc, np.uint32 if len(doc) == 4 * len(p) else np.int64).astype(np.int64)
            if len(key):
                hashes.append(np.frombuffer(key, np.uint32))
                own_d.append(d)
                own_p.append(p)
            else:
                docs.append(d)
                places.append(p)
        if hashes:
            h, d, p = map(np.concatenate, (hashes, own_d, own_p))
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            cut = _groups(h)
            low, high = np.minimum.reduceat(d, cut[:-1]), np.maximum.reduceat(d, cut[:-1])
            many = np.repeat((low != high) | (np.minimum.reduceat(p, cut[:-1]) < 0), np.diff(cut)) & (p >= 0)
            docs.append(d[many])
            places.append(p[many])
        d, p = np.concatenate(docs), np.concatenate(places)
        if not len(d):
            return None
        order = np.argsort(d, kind="stable")
        d, p = d[order], p[order]
        cut = _groups(d)
        return pa.RecordBatch.from_arrays([pa.array(d[cut[:-1]]), _binary(p, cut, 4)], ["doc_id", "places"])

    yield from _by_group(batches, "bucket", ("hash", "doc", "place"), verdict)


def _by_group(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...], act: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``act`` with the rows of each key of a sorted stream."""
    now, rows = None, []
    for b in batches:
        for k, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
            if k != now and rows:
                out = act(rows)
                if out is not None:
                    yield out
                rows = []
            now = k
            rows.append(values)
    if rows and (out := act(rows)) is not None:
        yield out


_SEGMENT_ROWS = "shard int, kind int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one shard and chunk, compressed together: segments of a language share most of their letters."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(r) for r in raw], np.int64).tobytes(), *raw]))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _packed(shard: np.ndarray, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    cols = [pa.array(shard.astype(np.int32)), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["shard", "kind", "blob"])


def _send_segments(window: int, anchor: int, shards: int) -> Callable:
    """Kind 0: distinct segments of a chunk with their smallest document and its places. Kind 1: ranges of documents
    that repeat a whole segment of a smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            parts = []
            text = []
            for b in chunk:
                data, offs = utf8(b.column("text"))
                s, e, at = words(data, offs)
                h = span_hash(data, s, e)
                row, first, last, a = _segments(h, at, window, anchor)
                wanted = np.zeros(len(s) + 1, bool)
                for i, places in enumerate(b.column("places").to_pylist()):
                    for p in places or ():
                        at_words = np.frombuffer(p, np.int32) + at[i]
                        wanted[at_words[at_words < at[i + 1]]] = True
                on = wanted[first]
                row, first, last, a = row[on], first[on], last[on], a[on]
                ids, tids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_id"))
                base = sum(map(len, text))
                text.append(data)
                parts.append(
                    (
                        _sequence_hash(h, first, last + window, 2 * window - anchor + 1), a, ids[row], tids[row], first - at[row], last - first + window,
                        s[first] + base, e[last + window - 1] + base,
                    )
                )
            key, a, doc, tid, place, n, b0, b1 = map(np.concatenate, zip(*parts, strict=True))
            if not len(key):
                continue
            data = np.concatenate(text)
            order = np.lexsort((place, tid, doc, key))
            key, a, doc, tid, place, n, b0, b1 = (x[order] for x in (key, a, doc, tid, place, n, b0, b1))
            cut = _groups(key)
            least = np.repeat(doc[cut[:-1]], np.diff(cut))
            mine = doc == least
            groups = np.flatnonzero(mine)
            cut = _groups(key[groups], tid[groups])
            head = groups[cut[:-1]]
            shard = (a[head] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, head, count = shard[order], head[order], np.diff(cut)[order]
            at = place[groups[np.repeat(cut[:-1][order], count) + runs(count)]].astype(np.int32)
            size = b1[head] - b0[head]
            raw = data[np.repeat(b0[head], size) + runs(size)]
            edge, mark = (np.concatenate([[0], np.cumsum(x)]) for x in (size, count))
            cut = _groups(shard)
            blobs = [
                _pack(size[x:z], doc[head[x:z]], tid[head[x:z]], count[x:z], at[mark[x] : mark[z]], raw[edge[x] : edge[z]])
                for x, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
            ]
            yield _packed(shard[cut[:-1]], 0, blobs)
            rest = np.flatnonzero(~mine)
            if len(rest):
                shard = np.abs(doc[rest] % shards)
                rest = rest[np.lexsort((place[rest], tid[rest], doc[rest], shard))]
                cut = _groups(np.abs(doc[rest] % shards))
                span = np.column_stack([place[rest], place[rest] + n[rest]]).astype(np.int32)
                blobs = [_pack(doc[rest[x:z]], tid[rest[x:z]], span[x:z]) for x, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield _packed(np.abs(doc[rest[cut[:-1]]] % shards), 1, blobs)

    return run


def _ranges(doc: np.ndarray, tid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    if not len(doc):
        return None
    order = np.lexsort((start, tid, doc))
    doc, tid, start, end = doc[order], tid[order], start[order], end[order]
    joined = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]) | (start[1:] > end[:-1])])
    first = np.flatnonzero(joined)
    end = np.maximum.reduceat(end, first)
    doc, tid, start = doc[first], tid[first], start[first]
    cut = _groups(doc, tid)
    span = np.column_stack([start, end]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.array(tid[cut[:-1]]), _binary(span, cut, 8)], ["doc_id", "text_id", "ranges"])


def _search(window: int) -> Callable:
    """FM-index of each shard, and the ranges of its segments that repeat words of a smaller document."""

    def shard(rows: list) -> pa.RecordBatch | None:
        out = [[], [], [], []]

        def put(doc: np.ndarray, tid: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            for x, y in zip(out, (doc, tid, start, end), strict=True):
                x.append(y)

        parts = []
        for kind, blob in rows:
            if kind:
                doc, tid, span = _unpack(blob, np.int64, np.int64, np.int32)
                put(doc, tid, span[::2], span[1::2])
            else:
                parts.append(_unpack(blob, np.int64, np.int64, np.int64, np.int64, np.int32, np.uint8))
        if parts:
            length, doc, own, each, places, data = map(np.concatenate, zip(*parts, strict=True))
            s, e, at = words(data, np.concatenate([[0], np.cumsum(length)]))
            h = span_hash(data, s, e)
            # rows of several tasks may hold one segment: the index takes it once, with its smallest document
            key = _sequence_hash(h, at[:-1], at[1:], int(np.diff(at).max()))
            order = np.lexsort((doc, key))
            cut = _groups(key[order])
            chosen = order[cut[:-1]]
            which = np.empty(len(doc), np.int64)
            which[order] = np.repeat(np.arange(len(chosen)), np.diff(cut))
            size = np.diff(at)[chosen]
            _, number = np.unique(h, return_inverse=True)
            text = np.zeros(int(size.sum()) + len(chosen), np.int64)
            begin = np.cumsum(size + 1) - (size + 1)
            text[np.repeat(begin, size) + runs(size)] = number[np.repeat(at[chosen], size) + runs(size)] + 1
            owner = np.repeat(doc[chosen], size + 1)
            index = FMIndex(text)
            many = size - window + 1
            starts = np.repeat(begin, many) + runs(many)
            live, lo, hi = matches(index, text, starts, window)
            first = np.full(len(text), np.iinfo(np.int64).max)
            if len(live):
                order = np.argsort(lo, kind="stable")
                cut = order[_groups(lo[order])[:-1]]
                least = np.minimum.reduceat(np.append(owner[index.sa], 0), np.column_stack([lo[cut], hi[cut]]).ravel())[::2]
                first[live] = least[np.searchsorted(lo[cut], lo)]
            # every place of every row: windows of the segment that start in a smaller document
            row = np.repeat(np.arange(len(doc)), each)
            place = places.astype(np.int64)
            whole = doc[chosen][which[row]] < doc[row]
            put(doc[row[whole]], own[row[whole]], place[whole], place[whole] + size[which[row[whole]]])
            row, place = row[~whole], place[~whole]
            w = many[which[row]]
            start = np.repeat(begin[which[row]], w) + runs(w)
            hit = np.flatnonzero(first[start] < np.repeat(doc[row], w))
            pick = np.repeat(np.arange(len(row)), w)[hit]
            where = place[pick] + runs(w)[hit]
            put(doc[row[pick]], own[row[pick]], where, where + window)
        return _ranges(*map(np.concatenate, out)) if out[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, "shard", ("kind", "blob"), shard)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_id, ranges): word ranges (pairs of 32-bit start and end) that repeat smaller documents.

    A range may come in several rows. ``text_id`` is the xxhash64 of the text.
    """
    spark = docs.sparkSession
    own = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = own.mapInArrow(_send_anchors(window, anchor, max(BUCKETS, 4 * parts)), _ANCHOR_ROWS)
    anchors = anchors.repartition("bucket").sortWithinPartitions("bucket")
    places = anchors.mapInArrow(_repeated, "doc_id long, places binary").groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    marked = own.withColumn("text_id", F.xxhash64("text")).join(cut_lineage(places).hint("merge"), "doc_id")
    segments = marked.select("doc_id", "text_id", "text", "places").mapInArrow(_send_segments(window, anchor, 4 * parts), _SEGMENT_ROWS)
    segments = segments.repartition("shard").sortWithinPartitions("shard")
    return segments.mapInArrow(_search(window), "doc_id long, text_id long, ranges binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every document."""
    found = cut_lineage(repeats(docs, window, anchor).groupBy("doc_id", "text_id").agg(F.collect_list("ranges").alias("ranges")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offs = utf8(b.column("text"))
            s, e, at = words(data, offs)
            edge = np.zeros(len(s) + 1, np.int64)
            for i, ranges in enumerate(b.column("ranges").to_pylist()):
                for r in ranges or ():
                    span = np.frombuffer(r, np.int32).reshape(-1, 2) + at[i]
                    np.add.at(edge, span[:, 0], 1)
                    np.add.at(edge, span[:, 1], -1)
            keep = np.cumsum(edge)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])
            size = (e - s)[keep] + 1
            buffer = np.append(data, np.uint8(32))
            at_byte = np.repeat(s[keep], size) + runs(size)
            ends = np.cumsum(size)
            at_byte[ends - 1] = len(data)  # the space after each word
            raw = buffer[at_byte].tobytes()
            byte = np.concatenate([[0], ends])
            k = left[at]
            kept = [raw[byte[x] : max(byte[x], byte[y] - 1)].decode("utf-8", "surrogatepass") for x, y in zip(k[:-1], k[1:], strict=True)]
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(n - np.diff(k)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    size = found.agg(F.sum(F.aggregate("ranges", F.lit(32).cast("bigint"), lambda n, r: n + F.octet_length(r)))).first()[0] or 0
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")
    joined = rows.join(side, ["doc_id", "text_id"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As :func:`remove_repeats`, with the SHA-256 of what is kept instead of the text."""
    out = remove_repeats(docs, window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
