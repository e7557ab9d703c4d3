"""Repeated word windows: super-k-mers travel to the bucket of their minimiser, where sorting counts windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from runloom.llm.common import per_worker
from runloom.session import cut_lineage

WINDOW = 20
MINIMISER = 2  # words of the sequences among which a window's least hash is its minimiser
LONG_WORD = 64  # bytes; a longer word travels as its SHA-256 behind a mark
SLICE_BYTES = 1 << 20  # text hashed at once
FLUSH_BYTES = 16 << 20  # text whose super-k-mers a task holds before it hands them on
BUCKET_BYTES = 4 << 20  # super-k-mers of a bucket, on average
HOT_BYTES = 4 * BUCKET_BYTES  # a larger bucket is counted window by window
BROADCAST_ROWS = 100_000  # hot buckets that are broadcast at most; more are joined
_MARK = b"\x00"
_BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, separated by ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def packed(words: list[bytes]) -> bytes:
    """Words joined by a space. A long word, or one that begins with the mark, is the mark and its digest."""
    joined = b" ".join(words)
    if len(joined) > LONG_WORD and max(map(len, words)) > LONG_WORD or _MARK in joined:
        joined = b" ".join([_MARK + hashlib.sha256(w).hexdigest().encode() if len(w) > LONG_WORD or w[:1] == _MARK else w for w in words])
    return joined


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""

    def build(base: int) -> np.ndarray:
        out = np.ones(n + 1, dtype=np.uint64)
        out[1:] = np.uint64(base)
        return np.cumprod(out, dtype=np.uint64)

    return build(_BASE), build(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Lines:
    """Lines of words, joined by line feeds: where words lie, and hashes of word sequences."""

    def __init__(self, joined: bytes):
        size = 1 << max(16, len(joined).bit_length())
        self.powers, self.inverse = per_worker(("window powers", size), lambda: _powers(size))
        buf = np.frombuffer(joined, dtype=np.uint8)
        feed = buf == 10
        at = np.flatnonzero((buf == 32) | feed)
        self.starts = np.concatenate(([0], at + 1))
        self.ends = np.concatenate((at, [len(buf)]))
        self.line = np.concatenate(([0], np.cumsum(feed[at])))
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.powers[: len(buf)], out=self.sums[1:])

    def hashes(self, width: int) -> np.ndarray:
        """A hash for each run of ``width`` words, line feeds ignored."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        starts = self.starts[:n]
        return _mixed((self.sums[self.ends[width - 1 :]] - self.sums[starts]) * self.inverse[starts])

    def inside(self, width: int) -> np.ndarray:
        """Whether the run of ``width`` words from each word on lies in one line."""
        n = len(self.starts) - width + 1
        return self.line[:n] == self.line[width - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def super_kmers(joined: bytes) -> tuple[np.ndarray, ...]:
    """(line, first word in it, begin, end, hash of the minimiser) of each super-k-mer of the lines.

    A super-k-mer is a longest run of windows of one line with the same, leftmost, minimiser.
    """
    lines = Lines(joined)
    valid = lines.inside(WINDOW)
    if not valid.any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    least = lines.hashes(MINIMISER)
    place = sliding_window_view(least, WINDOW - MINIMISER + 1).argmin(axis=1) + np.arange(len(valid))
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    last = np.flatnonzero(ends) + WINDOW - 1
    owner = lines.line[first]
    return owner, first - np.searchsorted(lines.line, owner), lines.starts[first], lines.ends[last], least[place[first]]


def _segments(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], bytes]]:
    """Lines of at most about SLICE_BYTES at once: (row key, first word) of each line, and the lines joined.

    A longer text is cut into lines that overlap by a window less one word.
    """
    owners, lines, held = [], [], 0
    for key, text in rows:
        words = words_of(text)
        if len(words) < WINDOW:
            continue
        step = SLICE_BYTES // (LONG_WORD + 2)
        for at in range(0, len(words) - WINDOW + 1, step):
            owners.append((key, at))
            lines.append(packed(words[at : at + step + WINDOW - 1]))
            held += len(lines[-1])
            if held >= SLICE_BYTES:
                yield owners, b"\n".join(lines)
                owners, lines, held = [], [], 0
    if lines:
        yield owners, b"\n".join(lines)


def blob_of(strings: list[bytes], places: list[tuple]) -> bytes:
    """Packed strings and their places (no id, doc_id, part, start) in one compressed string."""
    table = np.array(places, dtype=np.int64).reshape(-1, 4)
    return zstandard.compress(len(table).to_bytes(8, "little") + np.ascontiguousarray(table.T).tobytes() + b"\n".join(strings), 3)


def blob_content(blob: bytes) -> tuple[list[bytes], list[tuple]]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    table = np.frombuffer(raw, dtype=np.int64, count=4 * n, offset=8).reshape(4, n)
    return raw[8 + 32 * n :].split(b"\n"), list(zip(*table.tolist(), strict=True))


def bucketed(docs: DataFrame, buckets: int, sizes: bool = False) -> DataFrame:
    """The super-k-mers of all texts as rows (bucket, blob), or with ``sizes`` as rows (bucket, bytes).

    ``docs`` is (doc_id, part, text). A task keeps the first place of each packed string of some
    megabytes of text before it hands them on, so copies do not travel.
    """

    def flush(held: dict[tuple[int, bytes], tuple]) -> pa.RecordBatch:
        by: dict[int, tuple[list, list]] = {}
        for (bucket, string), place in held.items():
            strings, places = by.setdefault(bucket, ([], []))
            strings.append(string)
            places.append(place)
        if sizes:
            second = pa.array([sum(map(len, strings)) for strings, _ in by.values()], type=pa.int64())
        else:
            second = pa.array([blob_of(*x) for x in by.values()], type=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(by), type=pa.int64()), second], names=["bucket", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, tie, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                        yield (int(doc_id is None), doc_id or 0, tie), text

        held: dict[tuple[int, bytes], tuple] = {}
        taken = 0
        for owners, joined in _segments(rows()):
            lines, first, begins, ends, least = super_kmers(joined)
            where = (least % np.uint64(buckets)).astype(np.int64)
            for line, i, a, b, bucket in zip(*[x.tolist() for x in (lines, first, begins, ends, where)], strict=True):
                key, at = owners[line]
                place = (*key, at + i)
                item = (bucket, joined[a:b])
                old = held.get(item)
                if old is None or place < old:
                    held[item] = place
            taken += len(joined)
            if taken >= FLUSH_BYTES:
                yield flush(held)
                held, taken = {}, 0
        if held:
            yield flush(held)

    return docs.select("doc_id", "part", "text").mapInArrow(run, "bucket long, x long" if sizes else "bucket long, x binary")


FIRSTS = "none int, doc_id long, part long, start long, n long"


def _firsts(places: list[tuple], counts: list[int]) -> pa.Table:
    none, ids, parts, starts = zip(*places, strict=True) if places else ((), (), (), ())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(x, type=t) for x, t in zip((none, ids, parts, starts, counts), kinds, strict=True)]
    return pa.Table.from_arrays(columns, names=["none", "doc_id", "part", "start", "n"])


def _window_hashes(strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """(string, window in it, begin, end, hash) of every window of the strings."""
    lines = Lines(b"\n".join(strings))
    at = np.flatnonzero(lines.inside(WINDOW))
    owner = lines.line[at]
    head = np.searchsorted(lines.line, owner)
    zero = lines.starts[head]
    return owner, at - head, lines.starts[at] - zero, lines.ends[at + WINDOW - 1] - zero, lines.hashes(WINDOW)[at]


def first_windows(blobs: pa.Table) -> pa.Table:
    """Runs of windows of one bucket that start nowhere earlier: (none, doc_id, part, start, n).

    Strings are brought in the order of their places, so that a stable sort of the windows' hashes
    puts the first window of equal ones first; equal hashes are confirmed by the words themselves.
    """
    held: dict[bytes, tuple] = {}
    for blob in blobs.column("x").to_pylist():
        for string, place in zip(*blob_content(blob), strict=True):
            old = held.get(string)
            if old is None or place < old:
                held[string] = place
    items = sorted(held.items(), key=lambda x: x[1])
    parts, at, taken = [], 0, 0
    for k, (string, _) in enumerate(items):
        taken += len(string)
        if taken >= SLICE_BYTES or k == len(items) - 1:
            parts.append([x + at if i == 0 else x for i, x in enumerate(_window_hashes([s for s, _ in items[at : k + 1]]))])
            at, taken = k + 1, 0
    owner, offset, begin, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[order][1:] == h[order][:-1]
    first = np.ones(len(h), dtype=bool)

    def window(k: int) -> bytes:
        return items[owner[k]][0][begin[k] : end[k]]

    begun = -1
    seen: set[bytes] = set()
    for place in np.flatnonzero(same).tolist():
        if place != begun + 1:  # another run of equal hashes; its first window stands before
            seen = {window(order[place - 1])}
        begun, k = place, order[place]
        words = window(k)
        first[k] = words not in seen
        seen.add(words)
    begins = first.copy()
    begins[1:] &= ~first[:-1] | (owner[1:] != owner[:-1])
    ends = first.copy()
    ends[:-1] &= ~first[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    places = [(*items[o][1][:3], items[o][1][3] + i) for o, i in zip(owner[a].tolist(), offset[a].tolist(), strict=True)]
    return _firsts(places, (b - a + 1).tolist())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the blobs as a row (window, none, doc_id, part, start)."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            windows, places = [], []
            for string, (none, doc_id, part, start) in zip(*blob_content(blob), strict=True):
                lines = Lines(string)
                n = len(lines.starts) - WINDOW + 1
                for i, (a, b) in enumerate(zip(lines.starts[:n].tolist(), lines.ends[WINDOW - 1 :].tolist(), strict=True)):
                    windows.append(string[a:b])
                    places.append((none, doc_id, part, start + i))
            table = _firsts(places, [1] * len(places)).append_column("window", pa.array(windows, type=pa.binary()))
            yield from table.to_batches()


def all_firsts(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(none, doc_id, part, start, n): the runs of windows of (doc_id, part, text) that start nowhere earlier.

    There are as many buckets as make them ``bucket_bytes`` on average. What a bucket holds is measured; one of
    more than ``hot_bytes`` is not put together in a task: its windows are rows of their own, whose
    first place Spark finds by an aggregation that combines in tasks.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 3 * total // bucket_bytes)
    sizes = bucketed(docs, buckets, sizes=True).groupBy("bucket").agg(F.sum("x").alias("size"))
    hot = cut_lineage(sizes.where(F.col("size") > hot_bytes).select("bucket"))
    blobs = bucketed(docs, buckets)
    count = hot.count()
    if count:
        hot = F.broadcast(hot) if count <= BROADCAST_ROWS else hot
        large, blobs = blobs.join(hot, "bucket", "left_semi"), blobs.join(hot, "bucket", "left_anti")
    found = blobs.groupBy("bucket").applyInArrow(first_windows, FIRSTS)
    if not count:
        return found
    rows = large.select("x").mapInArrow(_windows, f"{FIRSTS}, window binary")
    least = rows.groupBy("window").agg(F.min(F.struct("none", "doc_id", "part", "start", "n")).alias("p"))
    return found.unionByName(least.select("p.*"))


def _kept(words: list[bytes], runs: list[tuple[int, int]] | None) -> np.ndarray:
    """Whether each word lies in no window but those of the runs (start, n)."""
    n = len(words) - WINDOW + 1
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    if n > 0:
        first = np.zeros(n + 1, dtype=np.int64)
        for start, count in runs or ():
            first[start] += 1
            first[start + count] -= 1
        again = np.flatnonzero(np.cumsum(first[:-1]) == 0)
        np.add.at(steps, again, 1)
        np.add.at(steps, again + WINDOW, -1)
    return np.cumsum(steps[:-1]) == 0


def deduplicate(docs: DataFrame, with_text: bool = True, **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every document.

    Words are separated by ASCII white space. A word goes if a window of WINDOW words covers it whose
    words also start earlier, in a document of smaller id or earlier in the same one; windows are judged
    on the input. ``kept`` is what stays, joined by one space, as binary UTF-8.

    Windows travel as super-k-mers, packed strings of about 29 words for 10 windows, to the bucket of their
    minimiser, once for all copies in a task's share. What comes back is the windows that are first,
    so common passages come back once. Texts are shuffled once, to meet them.

    Defined cases: null and empty texts have no words; a null id is larger than any other; rows that repeat
    an id count as documents of their own, in the order of their texts' hashes, and of rows alike in
    both all but one start later; long words are compared by SHA-256; an empty table gives no rows;
    other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = not own.groupBy("doc_id").count().where("count > 1").isEmpty()
    own = own.withColumn("part", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    # Keys that are never null, so that runs are dealt once: by them they are gathered and joined.
    keys = ["none", "id", *(["part"] if repeated else [])]
    found = all_firsts(own, **limits).withColumnRenamed("doc_id", "id").repartition(*keys)
    runs = found.groupBy(*keys).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    own = own.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "part")
    own = own if repeated else own.drop("part")  # a constant would fall out of the join's keys alone
    if repeated:
        own = own.groupBy("doc_id", *keys).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    else:
        own = own.withColumn("times", F.lit(1).cast("long"))
    met = own.join(runs, keys, "left")
    # Of rows alike, one has the windows that are first, the others none.
    first = F.struct(F.col("runs.start").alias("starts"), F.col("runs.n").alias("counts"), F.lit(1).cast("long").alias("times"))
    if repeated:
        none = F.lit(None).cast("array<bigint>")
        rest = F.struct(none.alias("starts"), none.alias("counts"), (F.col("times") - 1).alias("times"))
        met = met.select("doc_id", "text", F.explode(F.array(first, rest)).alias("x")).select("doc_id", "text", "x.*").where("times > 0")
    else:
        met = met.select("doc_id", "text", first.alias("x")).select("doc_id", "text", "x.*")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, starts, counts in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            words = words_of(text)
            keep = _kept(words, list(zip(starts, counts, strict=True)) if starts is not None else None)
            gone = len(words) - int(keep.sum())
            left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if gone else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(gone)
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left if with_text else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out = cut(rows)
                columns = [rows.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()), rows.column(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out, "times"])

    done = met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, times long")
    if repeated:
        done = done.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return done.drop("times", *([] if with_text else ["kept"]))
