"""Operators whose results have one right answer: SimHash, BPE, URL rules, token counts, neighbours."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from llm.cases import awkward, awkward_rows, none, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm import ann, attribution, bpe, simhash, tokens, urls
from runloom.llm.components import connected_components
from runloom.llm.queries import QUERIES
from runloom.llm.registry import vocabulary


def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def wide(longs):
    """Signed 64-bit integers as one number."""
    return sum((f % (1 << 64)) << (64 * k) for k, f in enumerate(longs))


def plain_classes(prints, radius):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in known}


@pytest.mark.parametrize("radius", [2, 6])
def test_simhash_against_all_pairs(spark, radius):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    base = prose(9, 200).split()
    for k in range(60):
        rng = random.Random(k)
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = rng.choice(base)
        rows.append((1000 + k, " ".join(words)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius).collect()
    assert len(found) == len(rows)
    root = plain_classes([plain_print(t) for _, t in rows], radius)
    least = {}
    for d, t in rows:
        if d is not None:
            least[root[plain_print(t)]] = min(d, least.get(root[plain_print(t)], d))
    want = collections.Counter((d, plain_print(t), least.get(root[plain_print(t)])) for d, t in rows)
    assert want == collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found)
    assert simhash.near_duplicates(none(spark)).count() == 0


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("distinct", [2, 300, 200_000, 10**10])
@pytest.mark.parametrize("radius", [0, 2, 6])
def test_every_segment_plan_finds_all_links(spark, monkeypatch, distinct, radius):
    if distinct > 10**9 and radius > 2:
        pytest.skip("balls of 32-bit segments are large")
    rng = random.Random(distinct + radius)
    prints = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        prints |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1))) for _ in range(3)}
    plan = simhash.segment_plan(distinct, radius)
    monkeypatch.setattr(simhash, "segment_plan", lambda *_: plan)
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(prints))], "doc_id long, f0 long")
    got = collections.defaultdict(set)
    for r in simhash.rooted(df, radius, 1).collect():
        got[r["root"]].add(r["f0"])
    want = collections.defaultdict(set)
    for f, root in plain_classes(prints, radius).items():
        want[root].add(signed(f))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("longs, radius", [(1, 6), (3, 32)])
def test_large_groups_cost_links_in_proportion(spark, monkeypatch, longs, radius):
    """20,000 different fingerprints, all near one another, beside two groups and single ones."""
    rng = np.random.default_rng(4)
    flips = rng.random((20_000, 64 * longs)) < (1.2 if longs == 1 else 8) / (64 * longs)
    bits = np.concatenate([(rng.random(64 * longs)[None] < 0.5) ^ flips, rng.random((3000, 64 * longs)) < 0.5])
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], ", ".join(["doc_id long", *[f"f{k} long" for k in range(longs)]]))
    made = []
    for name in ("_stars", "_across"):

        def counted(*args, real=getattr(simhash, name)):
            made.append(simhash.cut_lineage(real(*args)))
            return made[-1]

        monkeypatch.setattr(simhash, name, counted)
    found = simhash.rooted(df, radius, longs, simhash.likely_plan(23_000, 0.12) if longs == 3 else None).collect()
    sizes = collections.Counter(r["root"] for r in found)
    assert sizes.most_common(1)[0][1] >= 0.97 * len({tuple(w) for w in words[:20_000].tolist()}) and len(sizes) >= 3000
    assert made[0].count() <= 60 * len(found) and made[1].count() <= len(found)


@pytest.mark.parametrize("rows", [1, 100, 50_000, 10**6, 10**9])
def test_likely_plans_stay_within_their_longs(rows):
    plan = simhash.likely_plan(rows, 0.12)
    assert all(r == 1 and first % 64 + bits <= 64 for first, bits, r in plan) and len({p[0] for p in plan}) == len(plan)
    assert simhash.longs_of(plan) <= 32 and 2 ** plan[0][1] >= rows


def edited(rng, words, similarity):
    """The words with edits until the Jaccard similarity of five-word shingles is just above ``similarity``."""
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    out, base = list(words), shingles(words)
    while True:
        new = list(out)
        i = rng.randrange(len(new))
        new[i : i + rng.randint(0, 1)] = [f"w{rng.randrange(10**6)}"]
        theirs = shingles(new)
        if len(base & theirs) < similarity * len(base | theirs):
            return out
        out = new


def test_near_copies_of_similarity_four_fifths_go(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(80, 500))]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(edited(rng, words, 0.8)))]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(300))
    assert len(kept) <= 300 + 30


def test_deduplication_keeps_columns_of_any_name(spark):
    names = ["_id", "_fp", "_kept", "_text", "row", "id", "kept", "k_f0", "f0", "node", "class", "shared", "times"]
    docs = awkward(spark)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in simhash.deduplicate(awkward(spark)).collect()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (300, 7), (-4, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in [7, 300, *range(200, 260)]} == {-4} and 5 not in got


def test_one_document_of_each_class_stays(spark):
    rows = awkward_rows()
    kept = simhash.deduplicate(awkward(spark)).collect()
    prints = {r[1]: simhash.fingerprint(r[1], 3, 3) for r in rows}
    root = plain_classes([wide(p) for p in prints.values()], 32)
    assert collections.Counter(root[wide(prints[r["text"]])] for r in kept) == collections.Counter(set(root.values()))
    assert kept[0].asDict().keys() == awkward(spark).first().asDict().keys()
    assert 5 in {r["doc_id"] for r in kept} and 6 not in {r["doc_id"] for r in kept}
    assert simhash.deduplicate(none(spark)).count() == 0


def test_bpe_of_awkward_documents(spark):
    spec = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(spec.decode())
    found = bpe.encode(awkward(spark), spec).collect()
    want = collections.Counter()
    for d, text, *_ in awkward_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[d, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
    assert want == collections.Counter(tuple(r) for r in found)
    assert bpe.encode(none(spark), spec).count() == 0


def test_bpe_on_random_text():
    spec = vocabulary("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_str(spec.decode()), bpe.WordBpe(spec), random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list("aaaabcdeinthers   \n" * 20) + ["'s", "'LL", *bpe.SPECIAL, "</w>", "Σ", "日", "😀", "́"] * 4
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), repr(text)


def test_bpe_query_against_the_library(spark, sf_dir):
    library = Tokenizer.from_str(vocabulary("word_bpe_49k.json").decode())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


URLS = [
    None, "", "no scheme", "http://NET", "http://a.net/", "http://xnet/", "https://A.Example.net/en/1?x#y", "x://example.net/enx", "http://example.com/de/", "http://m.example.com/de",
    "http://example.com?/de/", "http://org/fr/a", "http://a.b.org/fr/#", "http://a.net:80/x", "://.net/", "http://é.org/fr/é", "a://b://net/",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), ("b.org", "/", "block"), (None, "/", "block")]


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_against_a_plain_search(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = collections.Counter((i, *plain_verdict(u)) for i, u in [*enumerate(URLS), (None, URLS[4]), (4, URLS[4])])
    assert want == collections.Counter(tuple(r) for r in urls.judge(pages, rules).collect())
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_meet_on_hash_prefixes_only(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "prefix" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("by_line", [True, False])
def test_token_counts_against_the_library_offsets(spark, rule, by_line):
    spec = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(spec.decode())
    found = collections.defaultdict(list)
    docs = awkward(spark).where("doc_id <> 8 AND doc_id <> 3 AND doc_id <> 5")
    for r in attribution.attribute(docs, spec, ["text", "source"], by_line=by_line, rule=rule).collect():
        found[r["doc_id"]].append(r)
    for doc, text, _, source, *_ in awkward_rows():
        if doc in (None, 3, 5, 8):
            continue
        whole = (text or "") + "\n" + (source or "")
        sections = sorted(found[doc], key=lambda r: r["section"])
        assert "".join(whole[r["start"] : r["start"] + r["length"]] for r in sections) == whole
        assert [r["section"] for r in sections] == list(range(len(sections)))
        want = [0] * len(sections)
        for begin, end in library.encode(whole, add_special_tokens=False).offsets:
            inside = [max(0, min(end, r["start"] + r["length"]) - max(begin, r["start"])) for r in sections]
            held = [i for i, n in enumerate(inside) if n]
            want[{"first": held[0], "last": held[-1], "most": int(np.argmax(inside))}[rule]] += 1
        assert want == [r["n_tokens"] for r in sections], text
    assert attribution.attribute(none(spark), spec, ["text"]).count() == 0


def test_token_counts_add_up(spark, sf_dir):
    library = Tokenizer.from_str(vocabulary("byte_bpe_50k.json").decode())
    total = {r["doc_id"]: r["n"] for r in QUERIES["op10_token_counts"](spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert total[r["doc_id"]] == len(library.encode(r["text"], add_special_tokens=False).ids)


def test_neighbours_of_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0, 0.0]), (9, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = sorted(tuple(r) for r in ann.search(df).collect())
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 9), (0, 3, 50), (0, 4, 2), (50, 1, 0), (50, 2, 1), (50, 3, 9), (50, 4, 2)]
    assert found[0][3] == 1.0 and found[3][3] == pytest.approx(0.5**0.5)
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((3000, 32)).astype(np.float32)
    vectors[1000:1600] = vectors[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in ann.search(df, block=700).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = vectors.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    hits = 0
    for q in range(0, 3000, 50):
        near = (x @ x[q]) / (norms * norms[q])
        near[q] = -9
        want = np.lexsort((np.arange(3000), -np.round(near, 12)))[:5]
        got = [v for _, v, _ in sorted(found[q])]
        assert len(got) == 5 and q not in got
        hits += len(set(got) & set(want.tolist()))
        if 1000 <= q < 1600:
            assert got == [v for v in [50, *range(1000, 1010)] if v != q][:5]
    assert hits >= 0.95 * 5 * 60


def test_hosts_of_many_labels_and_rules_of_many_lengths(spark):
    host = ".".join(["a"] * 100_000)
    rows = [(1, f"http://{host}/x"), (2, f"http://{'.' * 1_000_000}net/"), (3, "http://b.org/" + "p" * 6000), (4, "http://org/pq")]
    rules = [("a", "/", "block"), ("a.a.a", "/x", "allow"), ("net", "/", "block")] + [("org", "/" + "p" * n, ["allow", "block"][n % 2]) for n in range(5001)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {1: ("a.a.a/x", "allow"), 2: ("net/", "block"), 3: ("org/" + "p" * 5000, "allow"), 4: ("org/p", "block")}


def test_long_runs_of_white_space():
    spec = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_str(spec.decode()), tokens.ByteBpe(spec)
    for text in (" " * 5_000_000 + "x", "a" + "\t" * 400_000 + "\n" * 600_000, "b " * 200_000, " \n" * 60_000 + "end", "x" + "\r\n" * 49_999 + " y"):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
