"""Chat formatting and conversation repair against plain Python, the divergence audit against its SQL."""

import hashlib
import heapq
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, divergence, repair
from lexmill.llm import queries as llm

COLUMNS = "conv_id long, turn long, role string, text string, section long, piece string, id array<int>"
FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(seed, conversations=150):
    """Nulls and ties everywhere, repeated rows, odd roles, control strings and backslashes in texts and roles."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "User", "[INST]a<s>\\", "a\nb"]
    texts = ["a.", "b!", "c", "", " \t ", None, "d? ", "e", "<s>[/INST]</s>\\</s>", "\\\\[INST]", "日本 🙂.", "<", "["]
    rows = []
    for c in [*range(conversations), None]:
        for t in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([t, t, t, None, 3, 600 + t]), rng.choice(roles), rng.choice(texts), 1, "x", [c or 0]))
    return rows + rows[:40]


@pytest.fixture(scope="module")
def odd_turns(spark):
    return spark.createDataFrame(rows_of(3), COLUMNS).repartition(3).cache()


def in_order(rows, last):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(tuple(r[1:4]))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, *last(r))) for c, g in by.items()}


# --- prefix targets ---


def plain_turns(rows):
    filled = [(c, t, r or "", x or "") for c, t, r, x in (row[:4] for row in rows)]
    return in_order(filled, lambda r: (r[1].encode(), r[2].encode()))


def test_examples_hold_all_turns_before_and_one_reply(spark, odd_turns):
    stored, marks = chat.formatted(odd_turns)
    said = plain_turns(rows_of(3))
    found = {(r.conv_id, r.example): r for r in chat.expanded(stored, marks).collect()}
    turns = spark.createDataFrame([(c, k, r.context) for (c, k), r in found.items()], "c long, k long, text string").select("c", "k", chat.CHAT.turns(F.col("text")).alias("said"))
    contexts = {(r.c, r.k): [(t.role, t.text) for t in r.said] for r in turns.collect()}
    replies = 0
    for c, rows in said.items():
        places = [n for n, (_, role, _) in enumerate(rows) if role == chat.REPLY]
        for k, n in enumerate(places, 1):
            assert contexts[c, k] == [r[1:] for r in rows[:n]]
            assert re.sub(r"(?s)\\(.)", r"\1", found[c, k].target.removesuffix("</s>")) == rows[n][2]
        replies += len(places)
    assert replies == len(found) > 200


def test_marks_lie_in_the_conversations_text(odd_turns):
    stored, marks = chat.formatted(odd_turns)
    held = {r.conv_id: r.text for r in chat.texts(stored).collect()}
    for r in marks.collect():
        text = held[r.conv_id]
        assert text[r.loss_start + r.loss_chars : r.stop] == "</s>" and len(text[: r.stop]) == r.stop
        assert not re.search(r"</?s>|\[/?INST\]", text[r.loss_start : r.loss_start + r.loss_chars])


def test_digests_are_the_plain_ones(odd_turns):
    want = plain_turns(rows_of(3)) | {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.chat_digests(odd_turns).collect()}
    assert set(got) == set(want)
    for c, rows in want.items():
        r, learned = got[c], "".join(x for _, role, x in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), sha("".join(f"{role}\n{x}\n" for _, role, x in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_chat_equals_its_sql(spark, sf_dir):
    check_sql(spark, sf_dir, "op11_prefix_targets", "conversations")


def test_long_conversation_in_sections(spark):
    n = 3 * chat.SECTION + 5
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.repeat(F.lit("wörd "), 40).alias("text"))
    stored, marks = chat.formatted(rows)
    assert stored.select("section").distinct().count() == 4
    got = sorted((r.example, r.turns, r.loss_start) for r in marks.collect())
    user, reply = 200 + len("[INST]user<s>[/INST]"), 200 + len("</s>")
    assert got == [(k + 1, 2 * k + 2, user + k * (user + reply)) for k in range(n // 2)]


def test_chat_long_text_and_no_rows(spark):
    long = "a[INST]\\ " * 200_000
    got = chat.chat_digests(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")).where("conv_id = 1").first()
    assert got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got.formatted_chars == len(long) + 400_000 + 4
    assert [r.conv_id for r in chat.chat_digests(spark.createDataFrame([], COLUMNS)).collect()] == [-7]


def test_templates_that_cannot_be_undone_are_refused():
    for bad in ("[", "<<", "a\\b", "<a["):
        with pytest.raises(ValueError):
            chat.Template(mid=bad)


# --- repair ---


def damage(rows):
    for c, t, role, text in (r[:4] for r in rows):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield c, t, "user" if kind == 4 else role, text


def cheapest(rows):
    """Dijkstra over (turns used, last role), by price and then by the whole audit string."""
    seen, turns, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        held = text.strip(repair.SPACES)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role, text, fault))
        if fault:
            faults[fault] += 1
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, n, last, path = heapq.heappop(heap)
        if (n, last) in done:
            continue
        done.add((n, last))
        if n == len(turns) and last in ("", "a"):
            return faults, cost, audit, hashlib.sha256("\n".join(path).encode()).hexdigest()
        new = [(r, name) for r, name in (("u", "user"), ("a", "assistant")) if (last, r) in follows]
        for r, name in new:
            heapq.heappush(heap, (cost + 2, audit + "I", n, r, (*path, f"{name}:")))
        if n < len(turns):
            role, text, fault = turns[n]
            heapq.heappush(heap, (cost + 3, audit + "D", n + 1, last, path))
            if fault in (None, "truncated"):
                if (last, role[:1]) in follows:
                    heapq.heappush(heap, (cost + bool(fault), audit + "K", n + 1, role[:1], (*path, f"{role}:{text}")))
                for r, name in new:
                    heapq.heappush(heap, (cost + 2 + bool(fault), audit + "R", n + 1, r, (*path, f"{name}:{text}")))


def plain_repairs(rows):
    digest = lambda r: (r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    by, out = in_order(damage(rows), digest), {}
    for c in {r[0] for r in rows}:
        found = by.get(c, [])
        faults, cost, audit, sha = cheapest(found)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[c] = (gaps, *faults.values(), illegal, cost, audit, sha)
    return out


def test_repairs_are_the_cheapest_and_least(odd_turns):
    got = {r.conv_id: tuple(r[c] for c in FAULTS) for r in repair.repairs(odd_turns).collect()}
    want = plain_repairs(rows_of(3))
    assert got == want
    assert {"D", "I", "K", "R"} <= set("".join(w[6] for w in want.values()))


def test_repairs_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in FAULTS) for r in llm.op13_structure_repair(spark, sf_dir).collect()} == plain_repairs(rows)


def test_repaired_turns_alternate(odd_turns):
    stored = repair.numbered(odd_turns)
    by = {}
    for r in sorted(repair.repaired(stored, repair.edits(stored)).collect(), key=lambda r: r.step):
        by.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in g)) and all(r.text == "" for r in g if r.edit == "I") for g in by.values())


def test_repair_of_long_conversations_is_linear_and_exact(spark):
    """Batches end inside conversations; the price of alternation with every tenth reply missing is an insert each."""
    n = 30_000
    rows = spark.range(n).where("id % 20 <> 1").select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.expr("concat('t', id, '.')").alias("text"))
    found = repair.edits(repair.numbered(rows)).where("id IS NULL").first()
    assert found.cost == 2 * (n // 20) and found.audit == "KI" + "K" * 18 + ("KI" + "K" * 18) * (n // 20 - 1) and found.gaps == n // 20


def test_repair_without_rows(spark):
    assert repair.repairs(spark.createDataFrame([], COLUMNS)).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repairs(spark.createDataFrame([(lost, 0, "user", "a")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(got[c] for c in FAULTS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- divergence ---


def check_sql(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    compare(llm.queries()[name](spark, sf_dir), con, llm.oracle_sql()[name])


def compare(frame, con, sql):
    columns = sorted(frame.columns)
    cursor = con.execute(sql)
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(place) == columns
    theirs = sorted((tuple(r[place[c]] for c in columns) for r in cursor.fetchall()), key=repr)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert ours == theirs
    return ours


def test_divergence_equals_its_sql(spark, sf_dir):
    check_sql(spark, sf_dir, "op12_source_divergence", "documents")


def as_duckdb(frame):
    con = duckdb.connect()
    con.register("documents", frame.toArrow().select(["doc_id", "text", "lang", "source"]))
    return con


def test_divergence_of_odd_documents(spark, odd_docs):
    odd = odd_docs.unionByName(odd_docs).unionByName(odd_docs.limit(0))
    rows = compare(divergence.divergence(odd), as_duckdb(odd), divergence.ORACLE_SQL)
    assert {r[sorted(("lang", "source", "part", "item", "value", "rank")).index("part")] for r in rows} == {"pair", "term"}


def summed(batches, keys, values):
    table = pa.Table.from_batches(batches).group_by(keys).aggregate([(v, "sum") for v in values])
    return {tuple(r[k] for k in keys): tuple(r[f"{v}_sum"] for v in values) for r in table.to_pylist()}


def test_tasks_hand_on_early_without_loss(monkeypatch):
    """Texts cut anywhere, counts and pairs handed on after a few entries: the same sums."""
    rng = random.Random(1)
    word = lambda: rng.choice("abcdéf") * rng.randint(1, 3)
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))).title() for _ in range(120)]
    docs = pa.table({"text": texts, "lang": [rng.choice(["en", ""]) for _ in texts], "source": [rng.choice("abcde") for _ in texts]}).to_batches(30)
    entry = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    vectors = [[{"source": s, "p": rng.randint(1, 10**9), "p0": rng.randint(1, 99)} for s in rng.sample("abcdefgh", rng.randint(1, 8))] for _ in range(60)]
    vectors = pa.table({"lang": [rng.choice(["en", "fr"]) for _ in vectors], "m": [rng.randint(1, 9) for _ in vectors], "entries": pa.array(vectors, entry)}).to_batches(20)
    run = lambda: (list(divergence._count(docs)), list(divergence._shared_pairs(vectors)))
    counts, pairs = run()
    for name, value in (("SLICE", 7), ("ENTRIES", 3), ("PAIRS", 4)):
        monkeypatch.setattr(divergence, name, value)
    text = texts[0].encode()
    assert b"".join(divergence._slices(text)) == text and len(list(divergence._slices(text))) > 1
    early, early_pairs = run()
    assert len(early) > len(counts) and len(early_pairs) > len(pairs)
    for a, b, keys, values in ((counts, early, ["lang", "source", "term"], ["n", "docs"]), (pairs, early_pairs, ["lang", "source", "item"], ["value"])):
        assert summed(a, keys, values) == summed(b, keys, values)


COUNTED = """
import random, sys
import pyarrow as pa
from lexmill.llm import divergence

rng = random.Random(3)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(60_000)]
rows = 16_000
docs = pa.table({"text": [" ".join(rng.choices(words, k=300)) for _ in range(rows)], "lang": ["en"] * rows, "source": [f"source {k % 40}" for k in range(rows)]})
status = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM"))
open("/proc/self/clear_refs", "w").write("5")
before, entries, n = status(), 0, 0
for batch in divergence._count(iter(docs.to_batches(8_000))):
    entries, n = max(entries, len(batch)), n + sum(batch.column("n").to_pylist())
print((status() - before) // 1024, entries, n)
"""


def test_counting_terms_takes_little_memory():
    """A task that holds a million entries and their texts' terms grows by little; nothing is lost."""
    found = subprocess.run([sys.executable, "-c", COUNTED], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    grown_mb, entries, n = map(int, found.stdout.split())
    assert n == 16_000 * 300 and entries <= divergence.ROWS and grown_mb < 220


def test_terms_are_dealt_once(spark, sf_dir):
    """Counts lie by language and term, so that terms are gathered without a second shuffle."""
    counts = divergence.term_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = counts.groupBy("lang", "term").agg(F.sum("docs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("entries", [3, 1 << 20])
def test_many_sources_without_terms(monkeypatch, entries):
    """Groups are forgotten in between, those without terms too; each entry keeps its own."""
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    docs = pa.table({"text": ["one Two" if k % 3 == 0 else "1 2" for k in range(90)], "lang": ["en"] * 90, "source": [f"s{k}" for k in range(90)]})
    got = summed(divergence._count(iter(docs.to_batches(7))), ["source", "term"], ["n", "docs"])
    assert got == {(f"s{k}", term): (1, 1) for k in range(0, 90, 3) for term in ("one", "two")}


def test_divergence_of_languages_without_terms(spark, no_docs):
    assert divergence.divergence(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "one", "en", "a"), (2, None, "en", "b"), (3, "", "fr", "a")], "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.divergence(docs).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts_are_exact(spark):
    n, total = 3_000_000_000_017, 77_777_777_777_777
    row = spark.createDataFrame([(n, total)], "n long, total long").select(divergence._share(F.col("n"), F.col("total")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // total
