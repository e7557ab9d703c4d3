"""Token counts of fields and sections, from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.llm.common import map_arrow, per_worker
from runloom.llm.tokens import ByteBpe

RULES = ("most", "first", "last")
COUNTS = "field string, section long, start long, length long, n_tokens long"


def allocate(begins: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token span [begin, end), of sections that begin at ``cuts``, the last cut being the end.

    A token inside one section is that section's. One that crosses boundaries goes to the section that
    holds its first character (``first``), its last (``last``), or the most of its characters, the
    earliest of equals (``most``). Empty sections get none.
    """
    first = np.searchsorted(cuts, begins, side="right") - 1
    last = np.searchsorted(cuts, ends - 1, side="right") - 1
    if rule != "most":
        return first if rule == "first" else last
    out = first.copy()
    for t in np.flatnonzero(last > first):
        inside = np.arange(first[t], last[t] + 1)
        held = np.minimum(cuts[inside + 1], ends[t]) - np.maximum(cuts[inside], begins[t])
        out[t] = inside[held.argmax()]
    return out


def spans(ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from their byte lengths; a token with part of a character spans it whole."""
    stops = np.cumsum(lengths[ids])
    starts = stops - lengths[ids]
    leads = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(leads)))  # characters begun before each byte
    within = np.append(leads, True)
    return chars[starts] - ~within[starts], chars[stops]


def sections_of(text: str, by_line: bool) -> list[int]:
    """Lengths of a field's sections: its lines with their line ends, or the whole."""
    if not by_line:
        return [len(text)]
    lines = text.split("\n")
    return [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])


def attribute(
    docs: DataFrame, spec: bytes, fields: list[str], by_line: bool = True, rule: str = "most", joint: str = "\n", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, field, section, start, length, n_tokens): the tokens of every section of every document.

    A document is its ``fields`` joined by ``joint`` and is encoded once, as a whole, so the counts of its
    sections add up to its tokens exactly, which encoding them apart would not give. A joint belongs to
    the end of the field before it. Sections are lines with their line ends (``by_line``) or whole fields,
    numbered from 0 in the document; start and length are in characters of the document. Token spans
    follow from the byte lengths of the ids and meet the section boundaries in a sorted interval join;
    a token across boundaries is allocated by ``rule`` (see ``allocate``).

    Rows stay where they are; the vocabulary, a file of fixed size, is broadcast, and a task holds a few
    documents. Defined cases: a null field counts as empty; a field has at least one section, which may be
    empty; repeated rows and null ids are kept; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def process(batch: pa.RecordBatch) -> dict:
        bpe = per_worker(("byte_bpe", hash(held.value)), lambda: ByteBpe(held.value))
        rows: list[np.ndarray] = []
        ids_out, names, numbers, starts, sizes = [], [], [], [], []
        texts = [batch.column(1 + k).to_pylist() for k in range(len(fields))]
        for i, doc in enumerate(batch.column(0).to_pylist()):
            parts = [texts[k][i] or "" for k in range(len(fields))]
            parts = [p + joint for p in parts[:-1]] + parts[-1:]
            lengths = [sections_of(p, by_line) for p in parts]
            cuts = np.concatenate(([0], np.cumsum([n for own in lengths for n in own])))
            whole = "".join(parts)
            ids = np.frombuffer(bpe.encode(whole), dtype=bpe.dtype)
            counts = np.zeros(len(cuts) - 1, dtype=np.int64)
            if len(ids):
                begins, ends = spans(ids, bpe.lengths, whole.encode("utf-8", "surrogatepass"))
                counts = np.bincount(allocate(begins, ends, cuts, rule), minlength=len(counts))
            rows.append(counts)
            ids_out.extend([doc] * len(counts))
            names.extend(f for f, own in zip(fields, lengths, strict=True) for _ in own)
            numbers.extend(range(len(counts)))
            starts.extend(cuts[:-1].tolist())
            sizes.extend(np.diff(cuts).tolist())
        tokens = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return dict(zip(("doc_id", "field", "section", "start", "length", "n_tokens"), (ids_out, names, numbers, starts, sizes, tokens), strict=True))

    selected = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(fields)])
    return map_arrow(selected, process, f"doc_id long, {COUNTS}", rows=64)
