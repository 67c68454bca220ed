"""The table of contents against the headings: what it lacks, holds too much, or holds in another order.

Both are sequences of folded titles; the k-th entry of a title stands for the k-th heading of that title. What both hold is in order
along a longest common subsequence (of equally long ones, the one that keeps the earliest entries), the rest is misplaced.
A document's entries and headings are arrays in its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V

#: An entry: its title, a leader of dots, a tab or blanks, and a page number.
ENTRY = r"^(.*?\S)\s*(?:\.{3,}|…|\t|\s{2,})\s*(\d{1,4})$"
_CHAIN = "struct<length:int,place:int,at:int,path:array<int>>"


def _numbered(keys: Column) -> Column:
    """Each key with how many equal ones stand before it: array<struct<key, nth>>."""
    return F.transform(keys, lambda x, k: F.struct(x.alias("key"), F.size(F.filter(F.slice(keys, 1, k), lambda y: y == x)).alias("nth")))


def increasing(places: Column) -> Column:
    """The indexes of a longest increasing subsequence of ``places``, of equally long ones that of the earliest choices."""

    def step(chains: Column, place: Column) -> Column:
        able = F.filter(chains, lambda c: c["place"] < place)
        best = F.array_max(F.transform(able, lambda c: F.struct(c["length"].alias("length"), (-c["at"]).alias("at"), c["path"].alias("path"))))
        at = F.size(chains)
        path = F.concat(F.coalesce(best["path"], F.array().cast("array<int>")), F.array(at))
        chain = F.struct((F.coalesce(best["length"], F.lit(0)) + 1).alias("length"), place.alias("place"), at.alias("at"), path.alias("path"))
        return F.concat(chains, F.array(chain.cast(_CHAIN)))

    chains = F.aggregate(places, F.array().cast(f"array<{_CHAIN}>"), step)
    longest = F.array_max(F.transform(chains, lambda c: F.struct(c["length"].alias("length"), (-c["at"]).alias("at"), c["path"].alias("path"))))
    return F.coalesce(longest["path"], F.array().cast("array<int>"))


def with_summary(docs: DataFrame) -> DataFrame:
    """``docs`` (with blocks) and has_summary, entries array<struct<text, page>>, headings array<string> of what follows them.

    The entries are the lines right behind the heading SUMARIO that end in a page number. Without it, all headings count.
    """
    start = T.let(F.transform("blocks", lambda b: T.heading_base(T.fold_upper(F.coalesce(b["text"], F.lit("")))) == "SUMARIO"), lambda held: F.array_position(held, True))
    df = docs.withColumn("_start", F.coalesce(start, F.lit(0)).cast("int"))
    after = F.slice("blocks", F.col("_start") + 1, F.size("blocks"))
    df = df.withColumn("_after", F.when(F.col("_start") > 0, after).otherwise(F.col("blocks")))
    stop = T.let(F.transform("_after", lambda b: ~F.coalesce(b["text"], F.lit("")).rlike(ENTRY)), lambda held: F.array_position(held, True))
    df = df.withColumn("_stop", F.when(F.col("_start") == 0, 0).when(stop > 0, stop - 1).otherwise(F.size("_after")).cast("int"))
    entry = lambda b: F.struct(T.trim(F.regexp_extract(b["text"], ENTRY, 1)).alias("text"), F.regexp_extract(b["text"], ENTRY, 2).cast("int").alias("page"))
    rest = F.slice("_after", F.col("_stop") + 1, F.size("_after"))
    df = df.withColumn("has_summary", F.col("_start") > 0).withColumn("entries", F.transform(F.slice("_after", F.lit(1), F.col("_stop")), entry))
    heading = lambda b: (b["block_type"] == "heading") | T.heading_base(T.fold_upper(F.coalesce(b["text"], F.lit("")))).isin(*V.UNNUMBERED_HEADINGS)
    return df.withColumn("headings", F.transform(F.filter(rest, heading), lambda b: b["text"])).drop("_start", "_after", "_stop")


def summary_findings(docs: DataFrame) -> DataFrame:
    """doc_id, kind, place, text: what is wrong with each document's table of contents (``docs`` with blocks).

    kind: absent (rule 16; then nothing else), pretextual (17: an entry that belongs before the table), no-references (18), missing
    (a heading without entry), extra (an entry without heading), misplaced (an entry out of the headings' order), page (an
    entry whose page comes before that of the entry above). place: of the entry, or of the heading among those behind the table.
    """
    df = with_summary(docs)
    df = df.withColumn("_ours", _numbered(F.transform("entries", lambda e: T.fold_upper(e["text"])))).withColumn("_theirs", _numbered(F.transform("headings", T.fold_upper)))
    df = df.withColumn("_at", F.transform("_ours", lambda e: F.array_position("_theirs", e).cast("int")))
    df = df.withColumn("_both", F.filter(F.transform("_at", lambda p, k: F.struct(k.alias("k"), p.alias("p"))), lambda x: x["p"] > 0))
    df = df.withColumn("_chain", T.let(F.transform("_both", lambda x: x["p"]), increasing))
    df = df.withColumn("_kept", F.transform("_chain", lambda i: F.get(F.col("_both"), i)["k"]))
    found = lambda kind, k, text: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("place"), text.alias("text"))
    none = F.array().cast("array<struct<kind:string,place:bigint,text:string>>")
    told = lambda kind, able: F.array_compact(F.transform("entries", lambda e, k: F.when(able(e, k), found(kind, k, e["text"]))))
    base = lambda e: T.heading_base(T.fold_upper(e["text"]))
    findings = F.concat(
        told("pretextual", lambda e, k: base(e).isin(*V.PRE_TEXTUAL_HEADINGS)),
        F.when(F.exists("entries", lambda e: base(e) == "REFERENCIAS"), none).otherwise(F.array(found("no-references", F.lit(None), F.lit("")))),
        F.array_compact(F.transform("_theirs", lambda h, k: F.when(~F.array_contains("_ours", h), found("missing", k, F.get("headings", k))))),
        told("extra", lambda e, k: F.get(F.col("_at"), k) == 0),
        told("misplaced", lambda e, k: (F.get(F.col("_at"), k) > 0) & ~F.array_contains(F.col("_kept"), k)),
        told("page", lambda e, k: (k > 0) & (e["page"] < F.get(F.col("entries"), F.greatest(k - 1, F.lit(0)))["page"])),
    )
    absent = F.array(found("absent", F.lit(None), F.lit("")))
    return df.select("doc_id", F.inline(F.when(F.col("has_summary"), findings).otherwise(absent)))
