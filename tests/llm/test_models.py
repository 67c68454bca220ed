import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common, decontaminate, language, quality, toxicity
from lexmill.llm.queries import op5_rank_order_language

SF = "/root/testdata/sf0.001"


def _remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_languages_of_held_out_documents(spark, documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    rows = op5_rank_order_language(spark, SF).collect()
    assert all(r.held_out == (_remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.95


def test_languages_of_odd_documents(odd_docs, no_docs):
    rows = language.predicted_languages(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and {by_id[k].lang_pred for k in (3, 4, 5, 6)} == {"und"} and by_id[10].lang_pred in ("en", "fr")
    assert language.predicted_languages(no_docs).count() == 0
    unknown = language.predicted_languages(odd_docs.select("doc_id", "text", odd_docs["lang"].substr(9, 1).alias("lang")).where("doc_id is null"))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def _plain_codes(text):
    out = [0]
    for c in text.lower().replace("ς", "σ") + " ":
        code = ord(c) + 1 if c.isalpha() else 0
        if code or out[-1]:
            out.append(code)
    return out


def _plain_counts(text):
    """Hashed n-grams of a text one by one."""
    codes, found = _plain_codes(text), Counter()
    for n in (1, 2, 3):
        for k in range(len(codes) - n + 1):
            if n > 1 or codes[k]:
                mixed = codes[k]
                for c in codes[k + 1 : k + n]:
                    mixed = (mixed * 0x9E3779B1 + c) % 2**32
                found[(mixed * 0x85EBCA6B % 2**32 >> 16) + (n - 1) * 65536] += 1
    return found


def _plain_profile(found):
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))][:300]


def test_languages_equal_brute_force(spark, documents):
    docs = {r.doc_id: r for r in documents.collect()}
    counts = {k: _plain_counts(r.text) for k, r in docs.items()}
    learned = {}
    for k, r in docs.items():
        if r.lang is not None and _remainder(k, 3) != 1:
            learned.setdefault(r.lang, Counter()).update(counts[k])
    ranks = {x: {g: p for p, g in enumerate(_plain_profile(c))} for x, c in learned.items()}
    for r in op5_rank_order_language(spark, SF).collect():
        mine = _plain_profile(counts[r.doc_id])
        far = {x: sum(min(300, abs(at[g] - p)) if g in at else 300 for p, g in enumerate(mine)) / (300 * len(mine)) for x, at in ranks.items()}
        assert r.lang_pred == min(sorted(far), key=far.get) and abs(r.score - (1 - far[r.lang_pred])) < 1e-12


def test_profile_and_distance_by_hand():
    grams, counts = language.gram_counts("Ab ab")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == _plain_counts("Ab ab")
    profiles = language.Profiles({"x": [int(g) for g in language.profile(grams, counts)], "y": [1, 2, 3]})
    assert profiles.identify("ab AB") == ("x", 1.0) and profiles.distances("ab")[1] == 1.0


def test_parts_of_a_long_text_give_its_counts(monkeypatch):
    texts = ["ab cd " * 30, "ΟΔΟΣ ΣΑΣ. ab", "  \n", "x", "a" * 50, "é1é 日本語 İstanbul  !!  z"]
    for part in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "PART", part)
        for t in texts:
            grams, counts = language.gram_counts(t)
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == _plain_counts(t), (part, t)


def test_many_languages_are_compared_by_lists(monkeypatch, documents):
    texts = [r.text for r in documents.limit(60).collect()]
    ranked = {f"l{k}": [int(g) for g in language.profile(*language.gram_counts(t))] for k, t in enumerate(texts[:20])}
    dense = language.Profiles(ranked)
    monkeypatch.setattr(language, "DENSE_LANGUAGES", 3)
    lists = language.Profiles(ranked)
    assert lists.table is None and dense.table is not None
    for t in texts:
        assert np.allclose(lists.distances(t), dense.distances(t), rtol=0, atol=1e-12) and lists.identify(t)[0] == dense.identify(t)[0]


def _labels(spark):
    return spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_toxicity_of_held_out_documents(spark, larger):
    marks = {r.doc_id: r for r in _labels(spark).collect()}
    rows = toxicity.toxicity(larger, _labels(spark)).collect()
    assert all(r.held_out == (_remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, marks[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([p == t for p, t in held]) >= 0.9 and sum(p for p, t in held if not t) <= 2
    assert sum(p and t for p, t in held) >= 0.5 * sum(t for _, t in held)


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    x = (rng.random((4000, 30)) < 0.1).astype(np.float32)
    x[truth, 0] = 1
    x[~truth, 0] = 0
    w = toxicity.fit_nnpu(x[truth][:200], x, 0.2)
    z = np.hstack([x, np.ones((len(x), 1))]) @ w
    assert np.mean((z > 0) == truth) > 0.97


def test_nnpu_reaches_the_least_risk():
    rng = np.random.default_rng(5)
    p, u = (rng.random((300, 6)) < 0.5).astype(np.float32), (rng.random((900, 6)) < 0.3).astype(np.float32)
    prior = 0.2
    w = toxicity.fit_nnpu(p, u, prior, epochs=600, rate=0.02, batch=900)

    def risk(w):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    assert all(risk(w) <= risk(w + rng.normal(0, 0.3, len(w))) + 2e-3 for _ in range(200)) and risk(w) < risk(np.zeros_like(w))


def test_vocabulary_and_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"w{k}" for k in range(60)]
    texts = [(k < 40, sorted(set(rng.choices(names[: 30 if k < 40 else 60], k=12)))) for k in range(140)]
    monkeypatch.setattr(toxicity, "LEAST_CONTRAST", 1.0)
    contrast = {}
    for n in names:
        a, b = (sum(n in x for kind, x in texts if kind == p) for p in (True, False))
        mean = (a + b) / 140
        if a >= 3 and mean < 1:
            z = (a / 40 - b / 100) / np.sqrt(mean * (1 - mean) * (1 / 40 + 1 / 100))
            if z >= 1.0:
                contrast[n] = z
    rows = spark.createDataFrame(texts, "positive boolean, words array<string>")
    assert toxicity.vocabulary(rows, 40, 100) == sorted(contrast, key=lambda n: (-contrast[n], n)) and contrast
    base = {f"x{k}" for k in range(200)}
    hashes = [toxicity.min_hash(x) for x in (base, set(), base | {"y"}, {f"z{k}" for k in range(200)}, set(), base)]
    assert toxicity.distinct(hashes) == [0, 1, 3, 4]


def test_toxicity_scores_are_the_models(spark, larger):
    model = toxicity.Model({"bad": 1.5, "ugly*": 0.5, "fine": -2.0}, -0.25)
    for text, z in (("Bad, BAD; uglyness", -0.25 + 1.5 + 0.5), ("uglys fine", -0.25 + 0.5 - 2.0), ("", -0.25), (None, -0.25)):
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12
    assert abs(model.score("x ugly1 uglyx") - 1 / (1 + np.exp(-0.25))) < 1e-12


def test_quality_of_held_out_documents(spark, larger):
    marks = {r.doc_id: r for r in _labels(spark).collect()}
    rows = quality.quality(larger, _labels(spark)).collect()
    assert all(r.held_out == (_remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, marks[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([p == t for p, t in held]) >= 0.9


def test_quality_scores_equal_plain_compression(spark, larger):
    """The scores from zstandard's plain calls, and the curve from a search of the weighted loss."""
    import zstandard

    model = quality.learn(larger.select("doc_id", "text").where("doc_id % 5 <> 0"), _labels(spark).select("doc_id", "quality"))
    scale, slope, bias = model.curve

    def size(block, raw):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        return len(c.compress(block))

    rows = {r.doc_id: r.text for r in larger.limit(25).collect()}
    scores = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame([(k, False, t) for k, t in rows.items()], "doc_id long, held_out boolean, text string"), model).collect()}
    for k, t in rows.items():
        data = t.encode()
        parts = [data[s : s + 2048] for s in range(0, len(data), 2048)]
        x = sum(size(b, model.bad) - size(b, model.good) for b in parts) / max(1, len(data))
        assert abs(scores[k] - 1 / (1 + np.exp(-(slope * x / scale + bias)))) < 1e-9

    rng = np.random.default_rng(4)
    x, weight = rng.normal(0, 2, 400), rng.random(400) + 0.5
    y = (rng.random(400) < 1 / (1 + np.exp(-(x + 0.5)))).astype(float)
    scale, slope, bias = quality.fit_curve(x, y, weight)
    loss = lambda a, b: float((weight * np.logaddexp(0, -(2 * y - 1) * (a * x + b))).sum())
    assert all(loss(slope / scale, bias) <= loss(slope / scale + i, bias + j) + 1e-3 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))


def test_repeated_ids_give_one_text(spark, larger):
    """One id on very many rows is one text to learn from, wherever it is sampled."""
    docs = larger
    hot_id = docs.orderBy("doc_id").first().doc_id
    copies = spark.range(20_000).select(F.lit(hot_id).alias("doc_id"), F.concat(F.lit("copy "), F.col("id").cast("string")).alias("text"))
    chosen = docs.select("doc_id").limit(50).union(copies.select("doc_id").limit(1)).distinct().withColumn("kind", F.lit(1))
    both = docs.select("doc_id", "text").union(copies)
    found = common.one_text_each(both, chosen, "doc_id")
    assert found.count() == chosen.count()
    least = min([f"copy {k}" for k in range(20_000)] + [r.text for r in docs.where(F.col("doc_id") == hot_id).collect()], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert found.where(F.col("doc_id") == hot_id).first().text == least
    profiles = language.learn(docs.select("doc_id", "text", "lang").unionByName(copies.withColumn("lang", F.lit("xx"))))
    assert "xx" in profiles.languages and set("en fr".split()) <= set(profiles.languages)


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_scores_of_odd_documents_and_labels(spark, odd_docs, no_docs, score):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(11, 1, 0), (11, 0, 1), (10, 0, 1), (None, 1, 1), (9, None, None), (7, 1, 0)], schema)
    for marks in (labels, spark.createDataFrame([], schema), labels.where("doc_id = 7")):
        rows = score(odd_docs, marks).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        same = [r.score for r in rows if r.doc_id in (1, 2)]
        assert len(set(same)) == 1
    assert score(no_docs, labels).count() == 0


def _brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 70)).tolist(), rng.integers(0, 8, rng.integers(0, 90)).tolist()
        assert decontaminate.Pattern(a).common(b) == _brute_lcs(a, b)


def _passage_in(words, passage):
    return any(words[k : k + len(passage)] == passage for k in range(len(words) - len(passage) + 1))


def test_leaks_equal_brute_force(spark, larger):
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, decontaminate.bare_words(r.text)) for r in benchmark.collect()]
    expected = {(r.doc_id, i) for r in larger.collect() for i, p in items if _passage_in(decontaminate.bare_words(r.text), p)}
    found = decontaminate.contaminated(larger, benchmark).collect()
    assert expected and expected == {(r.doc_id, r.item_id) for r in found}


def test_paraphrases_and_odd_documents(spark, odd_docs, no_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    passage = [word() for _ in range(40)]
    changed = list(passage)
    for k in (3, 9, 15, 21, 27, 33):
        changed[k] = word()
    filler = lambda n: " ".join(word() for _ in range(n))
    schema = "doc_id long, text string, lang string"
    rows = [(1, f"{filler(300)} {' '.join(passage)} {filler(50)}", None), (2, f"{filler(77)}, {' '.join(changed).upper()}! {filler(100)}", None), (3, filler(400), None), (4, " ".join(passage[:15]) + " " + filler(100), None), (5, None, None), (None, " ".join(passage), None)]
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(7, " ".join(passage)), (8, None), (9, ""), (None, filler(30)), (10, filler(150))], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()), key=repr) == [(1, 7), (2, 7), (None, 7)]
    assert {r.doc_id for r in decontaminate.decontaminated(docs, benchmark).collect()} == {3, 4, 5}
    kept = decontaminate.decontaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0 == decontaminate.contaminated(docs, benchmark.where("item_id = 9")).count()


def test_part_borders_lose_no_leak(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    passage = [word() for _ in range(30)]
    docs = spark.createDataFrame([(1, " ".join(word() for _ in range(200)))], "doc_id long, text string")
    index = decontaminate.build_index(docs, decontaminate.passages([(1, " ".join(passage))]))
    texts = [" ".join([*(word() for _ in range(lead)), *passage, *(word() for _ in range(90))]) for lead in range(0, 140, 7)]
    column = pa.array(["", *texts, None, texts[0][:40], texts[3]], pa.string())
    expected = [[], *[[1]] * len(texts), [], [], [1]]
    for chunk in (500, 2500, 1 << 20):
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        for step in (16, 8192):
            monkeypatch.setattr(decontaminate, "STEP_WORDS", step)
            monkeypatch.setattr(decontaminate, "STEP_COSINES", step)
            monkeypatch.setattr(decontaminate, "STEP_BLOCKS", step // 4)
            assert [[h.item_id for h in x] for x in decontaminate.Searcher(index).found(column)] == expected


def test_numbers_of_words_equal_one_by_one(documents):
    rng = random.Random(9)
    bits = list(" \n\tabZ1'_-.!\"(ßÀéñÿ") + ["\x1c", "\x85", "\xa0", "\u3000", "İ", "Σ", "日本", "ﬁ", "«", "—", "🙂", "\x00", "ª"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [r.text for r in documents.limit(30).collect()]
    words = sorted({w for t in texts[::2] for w in decontaminate.bare_words(t)})
    number = {w: k for k, w in enumerate(words)}
    ids, lengths = decontaminate.Numbering(number).numbers(pa.array(texts, pa.string()))
    expected = [[number.get(w, -1) for w in decontaminate.bare_words(t)] for t in texts]
    assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == [k for x in expected for k in x]


def test_latent_recall_of_a_large_benchmark_against_brute_force(spark, monkeypatch):
    """Over 500 passages (two scans), short ones and some of 60 to 80 % of their words, within dense text of the same words."""
    monkeypatch.setattr(decontaminate, "FIT_DOCUMENTS", 20)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(3000)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, filler(rng.randint(11, 24))) for k in range(520)]
    texts = []
    for k in range(260):
        words = list(items[k][1])
        gone = set(rng.sample(range(len(words) - 3), int(len(words) * rng.choice([0, 0.2, 0.3, 0.38]))))
        texts.append(" ".join([*filler(80), *(f"new{j}x" if j in gone else w for j, w in enumerate(words)), *filler(80)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    expected = set()
    for d, text in enumerate(texts):
        words = decontaminate.bare_words(text)
        arounds = [words[max(0, at - 32) : at + 96] for at in range(0, len(words), 32)]
        for item, passage in items:
            pattern, answer, different = decontaminate.Pattern(passage), set(passage[-5:]), set(passage)
            # so few different words in common can't make a common subsequence of 60 %
            for around in (x for x in arounds if sum(w in different for w in x) >= 0.6 * len(passage)):
                share, held = pattern.common(around) / len(passage), len(answer & set(around)) / len(answer)
                if share >= 0.8 or (share >= 0.6 and held >= 0.6):
                    expected.add((d, item))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert len(expected) >= 240 and found <= expected and len(found) >= 0.95 * len(expected)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark, exact=True).collect()} == expected


def test_the_latent_search_decides(spark, larger, monkeypatch):
    """Without candidates of the latent search there are no rows; with them, all but chance common words of the exact count."""
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    exact = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(larger, benchmark, exact=True).collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(larger, benchmark).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 0
    index = decontaminate.build_index(larger, decontaminate.passages([(r.item_id, r.text) for r in benchmark.collect()]))
    texts = pa.array([r.text for r in larger.collect()], pa.string())
    assert sum(map(len, decontaminate.Searcher(index).found(texts))) == len(found)
    monkeypatch.setattr(decontaminate.Searcher, "_close", lambda *_: np.zeros(0, dtype=np.int64))
    assert not any(decontaminate.Searcher(index).found(texts)) and sum(map(len, decontaminate.Searcher(index, exact=True).found(texts))) == len(exact)
