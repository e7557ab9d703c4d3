"""Language mixtures, toxicity, quality and outliers."""

import collections
import re

import numpy as np
import pytest
from llm.cases import awkward, awkward_rows, none, prose
from pyspark.sql import functions as F

from runloom.llm import language, outliers, quality, statistics, toxicity
from runloom.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, n=15):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(n)] + [(None, 1, 1), (2, None, None), (3, 5, 5), (5, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


def auc(rows, marks):
    pos = np.array([r["score"] for r in rows if marks.get(r["doc_id"]) == 1])
    neg = np.array([r["score"] for r in rows if marks.get(r["doc_id"]) == 0])
    return np.mean([(neg < p).mean() + 0.5 * (neg == p).mean() for p in pos])


def test_language_of_awkward_documents(spark):
    names, model = language.learn(awkward(spark))
    rows = language.identify(awkward(spark), names, model).toArrow().to_pylist()
    assert len(rows) == len(awkward_rows()) and names == ["de", "en"]
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert language.identify(none(spark), names, model).count() == 0


def test_no_language_is_learned_from_nothing(spark):
    names, model = language.learn(none(spark))
    assert names == []
    found = language.identify(awkward(spark), names, model, keep=["doc_id"])
    assert {r["lang_pred"] for r in found.collect()} == {"und"}


def test_mixed_documents_get_both_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = language.learn(docs)
    texts = {lang: docs.where((F.col("lang") == lang) & F.length("text").between(1500, 4000)).first()["text"] for lang in ("en", "de")}
    share, _ = language.mixture(texts["en"][:1200] + "\n" + texts["de"][:1200], model, 2.0)
    assert {names[i] for i in np.flatnonzero(share > 0.3)} == {"en", "de"}
    share, _ = language.mixture(texts["en"], model, 2.0)
    assert share[names.index("en")] == 1.0


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    likely = np.where(rng.random((4000, 1)) < 0.7, [[1.0, 0.1, 0.1]], [[0.1, 1.0, 0.1]])
    share, value = language.expect_maximise(likely)
    grid = [(a, b, 1 - a - b) for a in np.arange(0.6, 0.81, 0.02) for b in np.arange(0.2, 0.41, 0.02) if a + b <= 1]
    assert value >= max(np.log(likely @ np.array(g)).sum() for g in grid) - 1.0
    assert abs(share[0] - 0.7) < 0.05 and share[2] < 0.05


def test_language_query_on_held_out_documents(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op2_language"](spark, sf_dir).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_toxicity_of_awkward_documents(spark):
    anything, other = F.lit(True), F.lit(True)
    rows = toxicity.detect(awkward(spark), labels(spark), anything, other).toArrow().to_pylist()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.detect(none(spark), labels(spark), anything, other).count() == 0
    unlabelled = toxicity.detect(awkward(spark), spark.createDataFrame([], LABELS), anything, other)
    assert {r["score"] for r in unlabelled.collect()} == {0.5}


def test_class_models_are_kneser_ney(spark):
    """Ratios equal those of a plain calculation, and each class's probabilities sum to one."""
    docs = [("bad words here bad", 1), ("good words there", 0), ("here good good", 0)]
    counts = toxicity.count_grams(spark.createDataFrame(docs, "text string, toxic int"), "text", "toxic")
    seen, _ = toxicity.class_models(counts)
    got = {r["g"]: r["llr"] for r in seen.collect()}
    c = {r["g"]: (r["t"], r["o"]) for r in counts.collect()}
    shift, order = toxicity.SYMBOL_BITS, toxicity.ORDER
    below, kinds = {}, {}
    at = list(c)
    for k in range(order - 1, 0, -1):
        kinds[k] = collections.Counter(g & ((1 << shift * k) - 1) for g in at)
        at = list(kinds[k])
    for k in range(1, order):
        total, different = collections.Counter(), collections.Counter()
        for g, n in kinds[k].items():
            total[g >> shift] += n
            different[g >> shift] += 1
        low = below
        below = {
            g: (n - 0.75 + 0.75 * different[g >> shift] * (low[g & ((1 << shift * (k - 1)) - 1)] if k > 1 else 1 / 4096)) / total[g >> shift]
            for g, n in kinds[k].items()
        }
    for side in (0, 1):
        ones = sum(v[side] == 1 for v in c.values())
        twos = sum(v[side] == 2 for v in c.values())
        d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        total, different = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g >> shift] += v[side]
            different[g >> shift] += v[side] > 0
        p = {}
        for g, v in c.items():
            ctx = g >> shift
            back = below[g & ((1 << shift * (order - 1)) - 1)]
            p[g] = (max(v[side] - d, 0) + d * different[ctx] * back) / total[ctx] if total[ctx] else back
        kinds[f"p{side}"] = p
    assert set(got) == set(c)
    for g, value in got.items():
        assert value == pytest.approx(np.log(kinds["p0"][g]) - np.log(kinds["p1"][g]), abs=1e-9)


def test_slots_agree_in_sql_and_numpy(spark):
    keys = [0, 1, 32, (1 << 60) - 1, 123456789012345678]
    model = spark.createDataFrame([(k, 1, float(i + 1)) for i, k in enumerate(keys)], "g long, n long, llr double")
    table = toxicity.dense(*toxicity.slotted(model))
    empty = (np.full(1 << toxicity.SLOT_BITS, -1), np.zeros(1 << toxicity.SLOT_BITS))
    assert toxicity.ratios(np.array(keys), table, empty).tolist() == [1, 2, 3, 4, 5]


def test_no_sequence_of_a_model_gives_way_to_another(spark):
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 60, 60_000))
    model = spark.createDataFrame([(int(k), 1, float(i % 1000 + 1)) for i, k in enumerate(keys)], "g long, n long, llr double")
    table = toxicity.dense(*toxicity.slotted(model))
    empty = (np.full(16, -1), np.zeros(16))
    assert toxicity.ratios(keys, table, empty).tolist() == [i % 1000 + 1 for i in range(len(keys))]


def test_sequences_of_any_alphabet_are_told_apart():
    words = ["".join(map(chr, range(a, a + 6))) for a in range(0x4E00, 0x9F00, 6)]
    found = {(int(g), int(w)) for word in words for g, w in [tuple(x[4] for x in toxicity.grams(word)[:2])]}
    assert len(found) == len(words)


@pytest.mark.parametrize("capacity", [0, 60, 400])
def test_joined_part_of_a_model_scores_like_the_broadcast_one(spark, monkeypatch, capacity):
    rows = [(i, prose(i, 30) + (" 日本語日本語 düster" if i % 3 else " 漢字仮名交") * (i % 4), i % 2) for i in range(24)]
    docs = spark.createDataFrame([*[r[:2] for r in rows], (50, None), (51, ""), (3, rows[3][1]), (None, "日本語 unheard of words")], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")

    def scores():
        found = toxicity.detect(docs, marks, F.col("doc_id") < 16, F.col("doc_id") >= 16)
        return sorted((tuple(r) for r in found.select("doc_id", "text", *toxicity.FEATURES, "score").collect()), key=repr)

    want = scores()
    monkeypatch.setattr(toxicity, "CAPACITY", capacity)
    got = scores()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-9, atol=1e-9)


def test_toxicity_query_on_held_out_documents(spark):
    """Trained on a bounded table of our tests' own scale, so the bar is a separation, not a rate."""
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_toxicity"](spark, sf).collect() if r["held_out"]]
    assert auc(rows, marks) > 0.85


def test_quality_of_awkward_documents(spark):
    rows = quality.classify(awkward(spark), labels(spark), F.lit(True)).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none(spark), labels(spark), F.lit(True)).count() == 0
    unlabelled = quality.classify(awkward(spark), spark.createDataFrame([], LABELS), F.lit(True))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(3)
    size = len(quality.FEATURES)
    data = {c: rng.normal(c, 1 + c, (500, size)) for c in (0, 1)}
    moments = {c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in data.items()}
    model = quality.Discriminant(moments, pooling=0.0, ridge=0.0)
    point = rng.normal(0, 1, size)
    want = 0.0
    for c, x in data.items():
        lean = size / (len(x) + size)
        own, both = np.cov(x.T, bias=True), sum(np.cov(y.T, bias=True) for y in data.values()) / 2
        cov = (1 - lean) * own + lean * both
        diff = point - x.mean(axis=0)
        want += (1 if c else -1) * (-0.5 * diff @ np.linalg.solve(cov, diff) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.difference(point[None])[0] == pytest.approx(want, rel=1e-6)


def test_quality_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_quality"](spark, sf).collect() if r["held_out"]]
    assert auc(rows, marks) > 0.95


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered)


def test_statistics_against_a_plain_count(spark, sf_dir):
    texts = [r[1] for r in awkward_rows()] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for text in [*texts, "a b c d e f g h " * 2, "a a a a a a a a a", " \x0b\n \n\x0c"]:
        assert statistics.measure(text)[:5] == plain_statistics(text)


def test_outliers_of_awkward_documents(spark):
    rows = outliers.judge(awkward(spark), least=3).toArrow().to_pylist()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])
    assert outliers.judge(none(spark)).count() == 0


def test_outliers_are_rejected_by_stratum(spark):
    """One document in ten is of odd symbols; the estimate does not follow it."""
    rows = [(i, prose(i, 120) if i % 10 else " ".join(w + "#$%" for w in prose(i, 120).split()), "en", f"s{i % 2}") for i in range(600)]
    found = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least=100).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {i for i in range(600) if i % 10 == 0}


@pytest.mark.parametrize("odd", ["symbols", "copies"])
def test_moderate_outliers_and_many_copies_are_rejected(spark, odd):
    """Every fourth word of some texts ends in symbols; or a third of a source are copies of one odd text."""
    copy = " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(prose(999, 120).split()))

    def text(i):
        words = prose(i, 120).split()
        if odd == "copies":
            return copy if i % 3 == 0 else " ".join(words)
        return " ".join(w + "##" * (k % 4 == 0) for k, w in enumerate(words)) if i % 20 == 0 else " ".join(words)

    rows = [(i, text(i), "en", "s0") for i in range(600)]
    found = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {i for i in range(600) if i % (3 if odd == "copies" else 20) == 0}


def test_a_small_source_is_judged_by_its_language(spark):
    """Short words are ordinary in one language and odd in the other, whose sources have five documents each."""

    def text(i, short):
        return " ".join(w[:2] if short else w for w in prose(i, 120).split())

    rows = [(i, text(i, False), "en", f"s{i // 5}") for i in range(600)] + [(1000 + i, text(1000 + i, True), "zz", f"s{i // 5}") for i in range(600)]
    rows += [(5000 + i, text(5000 + i, True), "en", f"s{i}") for i in range(10)]
    found = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    gone = {r["doc_id"] for r in found if not r["kept"]}
    assert gone >= set(range(5000, 5010)) and len(gone) <= 10 + 12


def test_concentration_step_takes_the_nearest(spark):
    """Centre and covariance of a stratum are those of the rows in its nearest bins."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (400, outliers.SIZE)) * outliers.UNIT).astype(int)
    x[:40] += 50 * outliers.UNIT
    df = spark.createDataFrame([("a", *map(int, r)) for r in x], "stratum string, " + ", ".join(f"{f} long" for f in outliers.FEATURES))
    params = outliers.start(df)
    for _ in range(2):
        params = outliers.moments(df, params).groupBy("stratum").applyInPandas(outliers.concentrate(0.75, False), outliers.SCHEMA)
    row = params.first()
    assert all(abs(row[f"m{i}"]) < 0.2 for i in range(outliers.SIZE))
