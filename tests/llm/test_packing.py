import collections

import numpy as np
import pytest
from llm.cases import awkward, awkward_rows, none
from tokenizers import Tokenizer

from runloom.llm import packing
from runloom.llm.queries import QUERIES
from runloom.llm.registry import vocabulary

SPEC = vocabulary("byte_bpe_50k.json")


def encoded(text):
    return Tokenizer.from_str(SPEC.decode()).encode(text or "", add_special_tokens=False).ids + [0]


def check(pieces, docs, window):
    """Every document's ids lie in its pieces once, sequences have no gaps, and only powers of two are short."""
    wanted = collections.Counter((d, tuple(encoded(t))) for d, t in docs)
    sequences = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
    total = collections.Counter()
    for (doc, size), parts in by_doc.items():
        same = sum(n for (d, ids), n in wanted.items() if d == doc and len(ids) == size)
        assert sum(len(ids) for _, ids in parts) == same * size
        if same == 1:
            whole = [i for _, ids in sorted(parts) for i in ids]
            assert (doc, tuple(whole)) in wanted
        total[doc] += same
    assert sum(total.values()) == len(docs)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1}])
def test_awkward_documents(spark, targets):
    pieces = packing.pack(awkward(spark), SPEC, window=64, quantum=16, block_tokens=5000, targets=targets).toArrow().to_pylist()
    check(pieces, [(r[0], r[1]) for r in awkward_rows()], 64)


def test_empty_table(spark):
    assert packing.pack(none(spark), SPEC).count() == 0


def test_without_separator_an_empty_text_has_no_piece(spark):
    pieces = packing.pack(awkward(spark), SPEC, separator=None).select("doc_id").distinct().toArrow()["doc_id"].to_pylist()
    assert 1 not in pieces and 8 in pieces


def test_windows_hold_the_mixture(spark):
    """With supply in every block, each window is within a quantum of its targets for each source."""
    rows = [(i, "word " * 30, None, f"s{i % 4 if i % 2 else 0}", 0, 0.0, "", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n int")
    pieces = packing.pack(df, SPEC, window=1024, quantum=64, block_tokens=40_000).toArrow().to_pylist()
    size = sum(p["length"] for p in pieces)
    share = collections.Counter()
    windows = collections.defaultdict(collections.Counter)
    for p in pieces:
        share[p["source"]] += p["length"] / size
        windows[p["sequence_id"]][p["source"]] += p["length"]
    off = [abs(w[s] - 1024 * share[s]) for w in windows.values() if sum(w.values()) == 1024 for s in share]
    assert np.quantile(off, 0.95) <= 2 * 64


def test_query_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toArrow().to_pylist()
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), SPEC).toArrow().to_pylist()
    check(pieces, [(d["doc_id"], d["text"]) for d in docs], 1024)
    rows = QUERIES["op1_packing"](spark, sf_dir).toArrow().to_pylist()
    import zlib

    want = sorted((p["doc_id"], p["start"], zlib.crc32(p["ids"]), p["sequence_id"], p["offset"]) for p in pieces)
    assert want == sorted((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
