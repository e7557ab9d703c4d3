"""Mixture-controlled packing of documents into token windows by deficit round-robin."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from runloom.llm.common import map_arrow, per_worker
from runloom.llm.tokens import ByteBpe
from runloom.session import cut_lineage, shared_path

PIECES = {
    "doc_id": pa.int64(), "source": pa.string(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
}
# Prefix sums over blocks are taken inside runs of so many blocks and over the runs.
RUN = 1024


def tokenize(docs: DataFrame, spec: bytes, separator: int | None = 0) -> DataFrame:
    """Rows (doc_id, source, n, ids, salt) of every document; ``ids`` holds little-endian integers.

    ``spec`` is the content of the vocabulary file, of fixed size, and is broadcast. A null text
    counts as empty. ``separator`` is the id that ends a document, null for none. Two-byte ids are
    written where the vocabulary allows it. ``salt`` tells repeated rows apart.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batch: pa.RecordBatch) -> dict:
        bpe = per_worker(("byte_bpe", hash(held.value)), lambda: ByteBpe(held.value))
        end = b"" if separator is None else np.array([separator], dtype=bpe.dtype).tobytes()
        ids = [bpe.encode(text) + end for text in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "source": batch.column(1),
            "n": pa.array([len(x) // bpe.dtype.itemsize for x in ids], type=pa.int64()),
            "ids": pa.array(ids, type=pa.binary()),
            "salt": pa.array(range(len(ids)), type=pa.int64()),
        }

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return map_arrow(rows, encode, "doc_id long, source string, n long, ids binary, salt long")


def tail_spans(total: int, window: int) -> list[tuple[int, int]]:
    """(begin, end) of the sequences after the last full window: powers of two, the largest first."""
    spans, begin = [], total // window * window
    for bit in reversed(range(window.bit_length())):
        if (total % window) >> bit & 1:
            spans.append((begin, begin + (1 << bit)))
            begin += 1 << bit
    return spans


def serve(queues: dict, credit: dict, share: dict, first: int, total: int, window: int, quantum: int) -> Iterator[tuple]:
    """Deficit round-robin over the queues of one block: (source, tokens, position, sequence, offset).

    A queue is a deque of the token counts of its documents. ``credit`` is each source's deficit at
    the block's first position and is carried on: at each window a source earns its share of the
    window's tokens. In its turn a source is served while its credit covers the quantum or the rest
    of its first document. When no turn can be served so, the source with the largest credit goes
    into debt by at most a quantum. Every window so holds its target proportions within a quantum a
    source, and what a window misses is made up by the next ones.

    Windows hold ``window`` tokens by global position; what remains of ``total`` after the last full
    one falls into ``tail_spans``, so no sequence needs padding.
    """
    full = total // window
    tail = tail_spans(total, window)
    turns = deque(s for s in queues if queues[s])
    position = first

    def give(s, n: int) -> tuple:
        credit[s] -= n
        queue = queues[s]
        queue[0] -= n
        if not queue[0]:
            queue.popleft()
        return s, n, position, sequence, position - begin

    while turns:
        if position < full * window:
            sequence, begin = position // window, position // window * window
            end = begin + window
        else:
            k = next(k for k, (_, e) in enumerate(tail) if e > position)
            sequence, (begin, end) = full + k, tail[k]
        room = end - position
        for s in turns:
            credit[s] += share[s] * room
        while room and turns:
            served = False
            for _ in range(len(turns)):
                s = turns[0]
                queue = queues[s]
                while room and queue and credit[s] >= min(quantum, queue[0]):
                    n = min(room, queue[0], int(credit[s]))
                    yield give(s, n)
                    served, room, position = True, room - n, position + n
                if not queue:
                    turns.popleft()
                elif room:
                    turns.rotate(-1)
                else:
                    break
            if room and turns and not served:
                s = max(turns, key=credit.__getitem__)
                n = min(room, queues[s][0], quantum)
                yield give(s, n)
                room, position = room - n, position + n
                if not queues[s]:
                    turns.remove(s)


def pack(
    docs: DataFrame,
    spec: bytes,
    window: int = 1024,
    targets: Mapping[str, float] | None = None,
    quantum: int = 256,
    block_tokens: int = 1 << 21,
    separator: int | None = 0,
) -> DataFrame:
    """Pack all documents into windows whose tokens follow target proportions by source.

    Takes (doc_id, text, source), further columns are ignored, and returns a row per piece of a
    document: doc_id, source, start (its document's ids before it), length, ids (little-endian
    32-bit), doc_tokens, sequence_id, offset. Every id lies in exactly one piece, sequences are
    filled without gaps, and the only sequences under ``window`` tokens are a last few whose lengths
    are powers of two.

    ``targets`` are relative token weights by source; sources without one weigh nothing and fill
    windows when nothing else can. Without targets the sources' shares of all tokens hold, which is
    the mixture that lasts to the last window.

    Documents are encoded once, into a table in the shared folder, and dealt by a hash of id,
    length and salt into blocks of about ``block_tokens`` tokens, so that each block is a mixture and a hot
    source spreads over all blocks. The tokens of each source in the blocks before give a block's
    first position and the sources' deficits there: deficits carry over windows and blocks while all
    blocks are served at once. A task holds one block and at most one document beyond it.

    Defined cases: a null text counts as empty and still yields its separator; a null source is a
    source; a null id is kept; repeated rows are packed one by one; equal ids are served in order of
    their content; an empty table gives no rows; without separator an empty text gives no piece.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    tokenize(docs, spec, separator).write.parquet(path)
    tokens = spark.read.parquet(path)
    kind = ByteBpe(spec).dtype.str
    total = tokens.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    dealt = tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", "n", "source", "salt"), F.lit(blocks)))
    counts = cut_lineage(dealt.groupBy("block", "source").agg(F.sum("n").alias("n")))  # read several times
    carry = block_carry(counts, targets, total)

    def run(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        return serve_block(rows, state, total, window, quantum, kind)

    return dealt.groupBy("block").cogroup(carry.groupBy("block")).applyInArrow(run, from_arrow_schema(pa.schema(list(PIECES.items()))))


def block_carry(counts: DataFrame, targets: Mapping[str, float] | None, total: int) -> DataFrame:
    """For each block and source in it: share, first position of the block, deficit there."""
    spark = counts.sparkSession
    per_source = counts.groupBy("source").agg(F.sum("n").alias("all"))
    if targets is None:
        shares = per_source.select("source", (F.col("all") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        weights = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
        joined = per_source.join(weights, per_source["source"].eqNullSafe(weights["source"]), "left").select(
            per_source["source"], F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
        whole = joined.agg(F.sum("weight").alias("whole"))
        shares = joined.join(F.broadcast(whole)).select(  # one row
            "source", F.when(F.col("whole") > 0, F.col("weight") / F.col("whole")).otherwise(0.0).alias("share")
        )
    counts = counts.withColumn("run", F.floor(F.col("block") / RUN))

    def before(df: DataFrame, keys: list[str]) -> DataFrame:
        """Sum of n over the blocks before, within keys: inside a run, plus the runs before."""
        runs = df.groupBy(*keys, "run").agg(F.sum("n").alias("m"))
        ahead = F.sum("m").over(Window.partitionBy(*keys, F.lit(0)).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        return runs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("run").alias("_run"), F.coalesce(ahead, F.lit(0)).alias("ahead"))

    within = Window.partitionBy("source", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_source = before(counts, ["source"])
    mine = counts.join(by_source, (F.col("run") == F.col("_run")) & F.col("source").eqNullSafe(F.col("_source"))).select(
        "block", "source", (F.col("ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("served")
    )
    whole = counts.groupBy("block", "run").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = whole.join(before(whole, []), F.col("run") == F.col("_run")).select(
        F.col("block").alias("_block"), (F.col("ahead") + F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("first")
    )
    shares = shares.withColumnRenamed("source", "_source")
    return (
        mine.join(first, F.col("block") == F.col("_block"))
        .join(shares, F.col("source").eqNullSafe(F.col("_source")))
        .select("block", "source", "share", "first", (F.col("share") * F.col("first") - F.col("served")).alias("deficit"))
    )


def serve_block(rows: pa.Table, state: pa.Table, total: int, window: int, quantum: int, kind: str) -> pa.Table:
    """The pieces of one block."""
    known = {r["source"]: r for r in state.to_pylist()}
    doc_ids, sources = rows["doc_id"].to_pylist(), rows["source"].to_pylist()
    ids = rows["ids"].to_pylist()
    dtype = np.dtype(kind)
    by_source: dict = {}
    for i in sorted(range(len(ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, ids[i])):
        if ids[i]:
            by_source.setdefault(sources[i], []).append(i)
    by_source = dict(sorted(by_source.items(), key=lambda x: (x[0] is None, x[0] or "")))
    queues = {s: deque(len(ids[i]) // dtype.itemsize for i in held) for s, held in by_source.items()}
    credit = {s: known[s]["deficit"] for s in queues}
    share = {s: known[s]["share"] for s in queues}
    first = state["first"][0].as_py() if state.num_rows else 0
    at = dict.fromkeys(queues, 0)  # the document served next, by source
    done = dict.fromkeys(queues, 0)  # its ids served so far
    out: list[tuple] = []
    for s, n, _, sequence, offset in serve(queues, credit, share, first, total, window, quantum):
        i = by_source[s][at[s]]
        start, size = done[s], len(ids[i]) // dtype.itemsize
        if out and out[-1][0] == i and out[-1][4] == sequence and out[-1][1] + out[-1][2] == start:
            out[-1] = (i, out[-1][1], out[-1][2] + n, size, sequence, out[-1][5])
        else:
            out.append((i, start, n, size, sequence, offset))
        done[s] = start + n
        if done[s] == size:
            at[s], done[s] = at[s] + 1, 0
    pieces = [np.frombuffer(ids[i], dtype=dtype, count=n, offset=start * dtype.itemsize).astype("<u4").tobytes() for i, start, n, *_ in out]
    columns = [
        [doc_ids[i] for i, *_ in out], [sources[i] for i, *_ in out], [x[1] for x in out], [x[2] for x in out], pieces,
        [x[3] for x in out], [x[4] for x in out], [x[5] for x in out],
    ]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, PIECES.values(), strict=True)], names=list(PIECES))
