import itertools
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import mixing, sharding, simhash

SF = "/root/testdata/sf0.001"


def _brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = {}
    for k, i in enumerate(ids):
        if i is not None:
            groups[root(k)] = min(groups.get(root(k), i), i)
    return [groups.get(root(k)) for k in range(len(ids))]


def _same_as_brute(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [_brute_fingerprint(t) for _, t in rows]
    expected = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], _brute_components([i for i, _ in rows], fps), strict=True), key=repr)
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert found == expected


def test_near_duplicates_equal_brute_force(documents, odd_docs):
    _same_as_brute(documents)
    _same_as_brute(odd_docs)


def test_every_link_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for flips in (1, 2, 3, 3, 4):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, flips, replace=False)))
    fps = np.array(sorted(fps), dtype=np.uint64)
    links = []
    packed = {}
    for s in range(0, len(fps), 50):
        for r, v, c in simhash._ball(fps[s : s + 50], 5):
            packed.setdefault(r, []).append((v, c))
    for parts in packed.values():
        v = np.frombuffer(b"".join(p[0] for p in parts), dtype="<u8")
        c = np.frombuffer(b"".join(p[1] for p in parts), dtype="<u2")
        links += list(zip(*(x.tolist() for x in simhash.links_of_range(v, c)), strict=True))
    parent = {f: f for f in fps.tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = list(range(len(fps)))
    expected = _brute_components(ids, fps.tolist())
    first = {}
    assert [first.setdefault(root(f), k) for k, f in enumerate(fps.tolist())] == expected


def test_pieces_of_a_long_text_give_the_same_fingerprint(monkeypatch, odd_docs):
    text = odd_docs.where("doc_id = 10").first().text
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.fingerprint(text.encode()) == whole == _brute_fingerprint(text)


def test_one_row_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = simhash._components(odd_docs)
    roots = groups[0].join(groups[1], "fp").select("root").distinct().count()
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == roots and ids.count(1) == 1 and 2 not in ids and 4 not in ids
    assert simhash.deduplicated(no_docs).count() == 0 == simhash.near_duplicates(no_docs).count()


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.connected(links).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def _brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_takings(odd_docs, documents, no_docs):
    for docs in (odd_docs, documents):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes, taken, largest = {}, {}, {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.times
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            largest[r.source] = max(largest.get(r.source, 0), r.size)
        expected = _brute_targets(sizes)
        for r in rows:
            assert abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)
    assert sorted(mixing.mix(odd_docs.repartition(5)).collect(), key=repr) == sorted(mixing.mix(odd_docs).collect(), key=repr)
    assert mixing.mix(no_docs).count() == 0


def test_mix_equals_its_sql(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "times"]
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in mixing.mix(documents).select(columns).orderBy("doc_id").collect()] == theirs


def _same_as_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "times"]
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall()
    rows = [tuple(r) for r in mixing.mix(docs).select(columns).collect()]
    assert sorted(rows, key=repr) == sorted(theirs, key=repr)
    return rows


def test_mix_splits_equal_rows(spark, odd_docs):
    """A third of the rows without an id or with one id, and equal rows on the cut and in the gap."""
    _same_as_sql(odd_docs)
    schema = "doc_id long, text string, source string"
    for n in (3, 40, 301):
        rows = [(None, "a b c", "hot")] * n + [(5, "d e", "hot")] * n + [(k, "f " * (k % 9), "hot") for k in range(n)] + [(k, "g " * (k % 5), "cold") for k in range(n // 3)] + [(1, "", None)] * 3
        docs = spark.createDataFrame(rows, schema).repartition(5)
        found = _same_as_sql(docs)
        taken = sum(r[5] for r in found if r[1] == "hot")
        assert abs(taken - next(r[4] for r in found if r[1] == "hot")) <= 4.5
        again = Counter(tuple(r) for r in mixing.mixed(docs).collect())
        assert again == Counter({(k, t, s): n for (k, t, s), n in _times(docs, found).items() if n})


def test_empty_texts_come_with_whole_repetitions_alone(spark):
    """Hundreds of texts without words in a source that is clamped, one that isn't and one that has nothing else."""
    schema = "doc_id long, text string, source string"
    rows = [(k, None if k % 3 else " ", "few") for k in range(400)] + [(1000 + k, "a b c", "few") for k in range(3)]
    rows += [(2000 + k, "", "many") for k in range(300)] + [(3000 + k, "d " * (k % 7), "many") for k in range(500)] + [(None, None, "none")] * 200
    docs = spark.createDataFrame(rows, schema).repartition(6)
    found = _same_as_sql(docs)
    assert {r[6] for r in found if r[1] == "few"} == {2} and {r[6] for r in found if r[1] == "none"} == {0}
    assert len({r[6] for r in found if r[1] == "many" and r[2] == 0}) == 1 < len({r[6] for r in found if r[1] == "many"})
    again = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    assert sum(n for (k, _, _), n in again.items() if k is not None and k < 400) == 800


def _times(docs, found):
    """How often the mix takes each distinct row, by doc_id, text and source; sizes tell its texts apart here."""
    out = Counter()
    for doc_id, source, size, _, _, _, times in found:
        out[doc_id, source, size] += times
    rows = {tuple(r) for r in docs.collect()}
    return {(k, t, s): out[k, s, len((t or "").split())] for k, t, s in rows}


CLASHING = ("size", "u", "key", "row", "high", "low", "times", "target", "source_size", "part", "score", "lang_pred", "searched", "_copy", "_key", "col", "kept_id", "whole", "edge", "fill")


def test_names_of_other_columns_do_not_clash(odd_docs):
    docs = odd_docs
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(k))
    for found in (mixing.mixed(docs), simhash.deduplicated(docs)):
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[name] == k for r in rows for k, name in enumerate(CLASHING))
    assert mixing.mix(docs).count() == odd_docs.count() == sharding.kd_shards(docs, 3).count() == simhash.near_duplicates(docs).count()


def test_mixed_rows_repeat(odd_docs):
    times = {(r.doc_id, r.size): r.times for r in mixing.mix(odd_docs).collect()}
    found = mixing.mixed(odd_docs)
    assert found.columns == odd_docs.columns
    assert sum(1 for r in found.collect() if r.doc_id == 11) == times[11, 400]


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(docs).collect()] == [(0, 0.0), (0, 0.0)]


def test_shards(odd_docs, documents, no_docs):
    rows = sharding.kd_shards(documents, 7).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(by_shard) == set(range(7)) and len(rows) == documents.count()
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())
    sizes = [sum(r.size for r in x) for x in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    odd = sharding.kd_shards(odd_docs, 40).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.shard < 40 for r in odd)
    assert {r.size for r in odd if r.doc_id == 3} == {16} and {r.text_crc32 for r in odd if r.doc_id == 4} == {0}
    assert sharding.kd_shards(no_docs, 40).count() == 0


def _brute_tree(points, shards):
    whole = {d: max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in ("length", "source", "lang")}
    out, todo = [], [(points, 0, shards)]
    while todo:
        rows, first, leaves = todo.pop()
        if leaves == 1 or not rows:
            out += [(p.doc_id, p.size, p.text_crc32, first) for p in rows]
            continue
        widest = max(whole, key=lambda d: (max(p[d] for p in rows) - min(p[d] for p in rows)) / whole[d])
        place = lambda p, d=widest: (p[d], p.tie, p.spread)
        goal, before = sum(p.size for p in rows) * (leaves // 2) / leaves, 0
        for at, group in itertools.groupby(sorted(rows, key=place), key=place):
            held = sum(p.size for p in group)
            if before + held >= goal:
                break
            before += held
        inclusive = goal - before >= held / 2
        left = [p for p in rows if place(p) < at or (inclusive and place(p) == at)]
        right = [p for p in rows if not (place(p) < at or (inclusive and place(p) == at))]
        todo += [(left, first, leaves // 2), (right, first + leaves // 2, leaves - leaves // 2)]
    return sorted(out, key=repr)


def test_shards_equal_a_brute_force_tree(documents, odd_docs):
    for docs, shards in ((documents, 40), (documents, 7), (documents, 300), (odd_docs, 5)):
        points = sharding.metadata(docs).collect()
        found = sharding.kd_shards(docs, shards).select("doc_id", "size", "text_crc32", "shard").collect()
        assert sorted(map(tuple, found), key=repr) == _brute_tree(points, shards)


def test_equal_rows_and_many_shards(spark):
    docs = spark.createDataFrame([(1, "same text", "en", "s")] * 3000 + [(k, "x" * (k % 50), "en", "t") for k in range(3000)], "doc_id long, text string, lang string, source string")
    rows = sharding.kd_shards(docs, 1500).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 6000 and len(sizes) >= 1400 and max(sizes.values()) <= 4 * sum(sizes.values()) / 1500


def test_a_hot_point_is_split(spark):
    docs = spark.createDataFrame([(k, "same text", "en", "s") for k in range(2000)], "doc_id long, text string, lang string, source string")
    counts = [r["count"] for r in sharding.kd_shards(docs, 40).groupBy("shard").count().collect()]
    assert len(counts) == 40 and max(counts) - min(counts) <= 2


def test_target_bytes_sets_the_number_of_shards(documents):
    total = sum(r.size for r in sharding.kd_shards(documents, 1).collect())
    assert sharding.kd_shards(documents, target_bytes=total // 5).select("shard").distinct().count() in (5, 6)
