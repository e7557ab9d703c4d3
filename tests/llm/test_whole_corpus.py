"""Manifest, repeated windows and spelling variants against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm.cases import SCHEMA, awkward, awkward_rows, none, prose
from pyspark.sql import functions as F

from runloom.llm import manifest, spelling, substrings


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def item(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(hashes):
    """Root, and for each leaf its steps (left, right)."""
    steps = [[] for _ in hashes]
    level = [(h, [i]) for i, h in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for k, (_, below) in enumerate(pair):
                left, right = (pair[0][0] if k else ""), (pair[1][0] if not k and len(pair) > 1 else "")
                for leaf in below:
                    steps[leaf].append((left, right))
            above.append((sha(*[h for h, _ in pair]), [x for _, below in pair for x in below]))
        level = above
    return level[0][0], steps


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(r, more=0):
        return sha(item(r[0]), item(r[3]), item(r[2]), item(None if r[4] is None else r[4] + more), item(r[1]))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = plain_tree([leaf(r) for r in groups[name]])
    root, upper = plain_tree([trees[n][0] for n in names])
    out = collections.Counter()
    for name, above in zip(names, upper, strict=True):
        for r, below in zip(groups[name], trees[name][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(tampered))
            for left, right in below + above:
                h = sha(left, h, right)
            proof = sha(*[x for step in below + above for x in step])
            out[r[0], leaf(r), trees[name][0], root, proof, h, h == root] += 1
    return out


def built_manifest(df):
    tamper = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = manifest.document_manifest(df, tamper).withColumn("proof", manifest.proof_digest(F.col("path"))).collect()
    return collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"]) for r in rows)


def test_manifest_of_awkward_rows(spark):
    assert built_manifest(awkward(spark)) == plain_manifest(awkward_rows())
    assert built_manifest(none(spark)) == collections.Counter()
    largest = [(7, "x", "en", "s", 2**63 - 1)]
    assert built_manifest(spark.createDataFrame(largest, "doc_id long, text string, lang string, source string, n_chars long")) == plain_manifest(largest)


@pytest.mark.parametrize("bits", [1, 2])
def test_manifest_of_several_levels(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 17, 33]
    rows = [(100 * g + i, f"text {i}", f"l{g}" if g else None, "s", i) for g, n in enumerate(sizes) for i in range(n)]
    rows += [rows[-1]] * 5
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows], SCHEMA)
    assert built_manifest(df) == plain_manifest(rows)


def plain_substrings(rows, width=20):
    """Rows (doc_id, text) to the multiset of (doc_id, n_words, n_removed, digest of what stays), ids different or rows alike."""
    words = [(r[0], (r[1] or "").encode("utf-8", "surrogatepass").split()) for r in rows]
    seen, marks = set(), []
    for _, ws in sorted(words, key=lambda x: (x[0] is None, x[0] or 0)):
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        marks.append(gone)
    out = collections.Counter()
    for (d, ws), gone in zip(sorted(words, key=lambda x: (x[0] is None, x[0] or 0)), marks, strict=True):
        out[d, len(ws), sum(gone), hashlib.sha256(b" ".join([w for w, g in zip(ws, gone, strict=True) if not g])).hexdigest()] += 1
    return out


def built_substrings(df, **limits):
    rows = substrings.deduplicate(df, **limits).collect()
    for r in rows:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)


def repeated_texts():
    rng = random.Random(3)
    passages = [prose(50 + i, n).split() for i, n in enumerate([20, 21, 30, 55, 200])]
    rows = []
    for d in range(120):
        words = prose(1000 + d, rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(words))
            words[at:at] = p[a : a + rng.randint(10, 120)]
        rows.append((d * 3 - 50, "\n ".join(words)))
    rows += [(900, "same " * 400), (901, "same " * 30), (902, "a b " * 100), (903, "x" * 500 + " " + prose(5, 40)), (904, "x" * 500 + " " + prose(5, 40))]
    rows += [(905, "\x00 " + prose(6, 30)), (906, "\x00 " + prose(6, 30)), (907, prose(7, 30_000)), (908, prose(7, 30_000) + " end")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"bucket_bytes": 500}, {"bucket_bytes": 4000, "hot_bytes": 100}, {"bucket_bytes": 4000, "hot_bytes": 6000}])
def test_substrings_against_plain(spark, limits):
    rows = repeated_texts()
    df = spark.createDataFrame([(d, t, "en", "s", 1, 1.0, "x", 2) for d, t in rows], SCHEMA).repartition(5)
    assert built_substrings(df, **limits) == plain_substrings(rows)


def test_long_texts_in_slices_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 3000)
    monkeypatch.setattr(substrings, "FLUSH_BYTES", 9000)
    rows = repeated_texts()
    assert built_substrings(spark.createDataFrame(rows, "doc_id long, text string")) == plain_substrings(rows)


def test_substrings_of_awkward_rows(spark):
    rows = [r for r in awkward_rows() if not (r[0] == 3 and r[1] == "another text")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert built_substrings(df) == plain_substrings([(r[0], r[1]) for r in rows])
    assert built_substrings(none(spark)) == collections.Counter()
    assert built_substrings(awkward(spark)).total() == len(awkward_rows())


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(w)) <= 1 and near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), None if form is None else counts[form])
    rows = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, n, k, m)
    return rows


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def invented_words():
    rng = random.Random(8)
    words = collections.Counter()
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for s in stems:
        words[s] += rng.choice([1, 30, 400, 9000])
        for _ in range(12):
            i = rng.randrange(len(s) + 1)
            t = rng.choice([s[:i] + rng.choice("abcé") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcé") + s[i + 1 :]])
            if t:
                words[t] += rng.choice([1, 2, 3, 40])
    words.update({"a" * k: k for k in range(1, 30)})
    words.update({"ab" * 700: 5, "ab" * 700 + "a": 60, "b" + "ab" * 700: 3})
    return dict(words)


@pytest.mark.parametrize("most", [20_000, 30, 2])
def test_variants_against_all_pairs(spark, most):
    words = invented_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found_variants(spelling.variants(df, most=most)) == plain_variants(words)


def test_composition_against_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))})
        pairs = list(spelling.compose(spelling.acceptor(words, 0)))
        want = {(x, y) for x, y in itertools.combinations(words, 2) if near(x, y)}
        assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == {tuple(sorted(p)) for p in want}


def plain_words(rows):
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def test_spelling_of_documents(spark, sf_dir):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(50 + i, prose(i, 3000).upper().title() + " ÉÈ×ÿ" * 4) for i in range(30)]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 1.0, "x", 2) for d, t in rows], SCHEMA)
    found = found_variants(spelling.spelling_variants(df, slip=31))
    want = plain_words(rows)
    assert {w: v[2] for w, v in found.items()} == want and len(want) > 100
    some = {w for w, v in found.items() if v[0]} | set(list(want)[:150])
    for w in some:
        others = [o for o in want if near(w, o)]
        best = min(others, key=lambda o: (-want[o], o), default=None)
        form = best if best and want[best] >= 10 * want[w] else None
        assert (found[w][0], found[w][3]) == (form, len(others))
    assert any(v[0] for v in found.values())
    assert spelling.spelling_variants(none(spark)).count() == 0
