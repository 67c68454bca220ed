from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect_in_order(spark, sf_dir, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_id_output"]
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), f"test-{name}")
        sizes.append(docs.count())
        if name != names[-1]:
            assert docs.columns == documents.columns
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[4] == sizes[3] and sizes[1] < documents.count()
    rows = docs.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_language_stage_rejects_only_texts_without_language(spark, sf_dir, odd_docs):
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, odd_docs, sf_dir).collect()}
    assert not kept & {3, 4, 5, 6} and {1, 7, 9, 10, 11} <= kept


def test_stages_take_any_columns_and_no_rows(spark, sf_dir, documents, no_docs):
    clashing = documents
    for k, name in enumerate(("lang_pred", "score", "size", "times", "key", "row", "target", "searched")):
        clashing = clashing.withColumn(name, F.lit(k))
    for docs in (clashing, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            found = corpus_pipeline.staged(stage(spark, docs, sf_dir), f"test-{name}")
            assert (found.count() > 0) == (docs is clashing), name
            if name != "token_id_output":
                assert found.columns == docs.columns
                assert docs is no_docs or found.where("score <> 1 or lang_pred <> 0 or target <> 6").isEmpty()
            docs = found if docs is clashing and name != "token_id_output" else docs
            if docs is not no_docs:
                clashing = docs


def test_the_run_keeps_no_stage_but_the_last(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_the_pipeline_equals_brute_force(spark, sf_dir, documents):
    """Every stage done over again in plain Python on its own input, the mix in SQL."""
    import zlib
    from collections import Counter

    import duckdb
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lexmill.llm import decontaminate, mixing
    from lexmill.llm.common import benchmark
    from lexmill.llm.queries import vocabulary
    from test_dedup_mix_shards import _brute_components, _brute_fingerprint
    from test_models import _plain_counts, _plain_profile

    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in documents.collect())
    counts = {d[0]: _plain_counts(d[1]) for d in docs}
    learned = {}
    for d in docs:
        learned.setdefault(d[2], Counter()).update(counts[d[0]])
    ranks = [{g: p for p, g in enumerate(_plain_profile(c))} for c in learned.values()]

    def closeness(k):
        mine = _plain_profile(counts[k])
        return max(1 - sum(min(300, abs(at[g] - p)) if g in at else 300 for p, g in enumerate(mine)) / (300 * len(mine)) for at in ranks) if mine else 0

    docs = [d for d in docs if closeness(d[0]) >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    groups = _brute_components([d[0] for d in docs], [_brute_fingerprint(d[1]) for d in docs])
    docs = [d for d, least in zip(docs, groups, strict=True) if d[0] == least]
    passages = decontaminate.passages([(r.item_id, r.text) for r in benchmark(spark, sf_dir).collect()])

    def leaks(text):
        words = decontaminate.bare_words(text)
        for at in range(0, len(words), 32):
            around = words[max(0, at - 32) : at + 96]
            for p in passages:
                if sum(w in around for w in set(p.words)) < 0.3 * len(set(p.words)):
                    continue
                share, held = decontaminate.Pattern(p.words).common(around) / len(p.words), len(set(p.words[-5:]) & set(around)) / len(set(p.words[-5:]))
                if share >= 0.8 or (share >= 0.6 and held >= 0.6):
                    return True
        return False

    docs = [d for d in docs if not leaks(d[1])]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[3] for d in docs]}))
    times = dict(con.execute(f"SELECT doc_id, times FROM ({mixing.ORACLE_SQL})").fetchall())
    library, start, expected = Tokenizer.from_file(vocabulary()), 0, []
    for d in docs:
        ids = np.array([*library.encode(d[1], add_special_tokens=False).ids, 0], dtype="<u4")
        for _ in range(times[d[0]]):
            expected.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected
