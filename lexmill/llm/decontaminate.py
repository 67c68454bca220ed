"""Benchmark decontamination by latent semantic retrieval.

1. Vocabulary: the words of the benchmark's passages. Their document frequency is counted over the blocks
   (BLOCK words) of every document; words in many blocks carry no evidence and are left out, but each passage
   keeps its rarest ones.
2. Index: a distributed randomised SVD of TF-IDF blocks. Each task multiplies its rows with the shared basis and
   sends back one vocabulary-sized matrix; three such passes (range finder and power iterations) over a bounded,
   documented sample of documents plus all benchmark passages give the latent space.
3. Search: every block of every document is projected. Windows of two blocks, moved by one, are compared with all
   passages by cosine, and by how much of a passage's vector they hold; TF-IDF is linear, so a window is the sum
   of its blocks. Both bars lie low: the check decides what a candidate is worth. A scan searches for no more passages
   than the space has dimensions for, so that it holds each of them; more passages take more scans. With ``exact``
   windows that hold enough of a passage's rarest words to pass the check are candidates too; whatever the check would
   accept then is one, and what the latent search alone finds of it is its recall.
4. Check: for each candidate the longest common subsequence of the passage's words with the window (and a block on
   either side) must cover enough of the passage. A near-verbatim match decides alone; a paraphrase must also
   hold the passage's answer, its closing words.

Documents are only scanned: nothing is shuffled but sums of vocabulary size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.llm.common import chunks, fresh, one_text_each, staged

BLOCK = 32
#: Share of blocks from which on a word is left out, and the rarest words that each passage keeps anyway.
COMMON = 0.01
KEPT_PER_PASSAGE = 8
#: Documents that the SVD is fitted on at most (those of least seeded hash); every block is indexed.
FIT_DOCUMENTS = 2_000
#: Dimensions of the latent space beyond one for each passage of the scan.
OVERSAMPLE = 16
#: Benchmark passages searched for in one scan; more passages take more scans. A scan's index, words by dimensions, is
#: broadcast: with passages of a window's length it has at most 496 * 64 * 512 numbers, 65 MB.
PASSAGES_PER_SCAN = 496
#: How much more a passage counts in the fit than a block of the sample, so that the space holds the passages first.
PASSAGE_WEIGHT = 30.0
POWER_PASSES = 2
COSINE = 0.3
#: Least part of a passage's latent vector that a window must hold along it.
CONTAINED = 0.4
#: Words with evidence that a window must hold to be compared at all, or fewer if the least passage has few.
LEAST_KNOWN = 5
#: Rare words of a passage counted beyond those that the check lets be absent; so many must be there, if it has them.
SPARE_WORDS = 3
#: Share of a passage's words in the common subsequence: alone, and together with the answer.
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER_WORDS = 5
ANSWER = 0.6
#: Bytes of texts numbered at once; a longer text is numbered in parts of about as many characters.
CHUNK = 4 << 20
#: Partitions of the fit's sample, and values of one slice of a matrix on its way through a shuffle.
FIT_PARTITIONS = 16
SLICE = 1 << 20
#: Words projected, and cosines compared, at once.
STEP_WORDS = 8192
STEP_COSINES = 2_000_000
#: Blocks whose vectors are held at once.
STEP_BLOCKS = 1 << 14
#: Empty blocks after each text of a stream: a window and the block on either side never hold two texts.
GAP = 2

_EDGE = re.compile(r"^\W+|\W+$")
_ASCII_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_GAP = re.compile(r"\s")


def bare(token: str) -> str:
    """The token in lower case without punctuation around it."""
    word = token.lower().strip(_ASCII_EDGE)
    return word if word.isalnum() else _EDGE.sub("", word)


def bare_words(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


@dataclass
class Passage:
    item_id: int
    part: int
    words: list[str]


def passages(items: list[tuple[int, str | None]]) -> list[Passage]:
    """Each item's words, items longer than a window in parts of near-equal length; items without words go."""
    out = []
    for item_id, text in items:
        words = bare_words(text)
        parts = -(-len(words) // (2 * BLOCK))
        for k in range(parts):
            out.append(Passage(item_id, k, words[len(words) * k // parts : len(words) * (k + 1) // parts]))
    return out


def parts_of(text: str, size: int):
    """The text in parts of about ``size`` characters, cut at white space."""
    start = 0
    while len(text) - start > size:
        gap = _GAP.search(text, start + size)
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


class Numbering:
    """The numbers of the bare words of whole texts in a vocabulary, many texts at once; one in each worker."""

    def __init__(self, number: dict[str, int]):
        self.number, self.words = number, pa.array(list(number), pa.string())

    def _of_tokens(self, tokens: pa.Array) -> np.ndarray:
        """By token: the number of its bare word, -1 if the vocabulary lacks it, -2 if it has no word."""
        low = pc.utf8_trim(pc.utf8_lower(tokens), characters=_ASCII_EDGE)
        found = pc.fill_null(pc.index_in(low, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        # what is left of a token of plain letters, digits and punctuation has neither punctuation nor odd case rules
        plain = pc.and_(pc.match_substring_regex(tokens, _PLAIN), pc.not_equal(low, "")).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(~plain).tolist():
            word = bare(tokens[k].as_py())
            found[k] = self.number.get(word, -1) if word else -2
        return found

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts one after another, words of each text)."""
        split = pc.utf8_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        tokens = split.flatten().dictionary_encode()
        ids = self._of_tokens(tokens.dictionary)[tokens.indices.to_numpy()]
        kept = ids != -2
        upto = np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]]
        return ids[kept], np.diff(upto)

    def of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``numbers`` of a column's rows in order, about CHUNK bytes at a time; a null counts as empty."""
        for texts in chunks(column, CHUNK):
            if len(texts) == 1 and len(text := texts[0].as_py()) > CHUNK:
                parts = [self.numbers(pa.array([x], pa.string()))[0] for x in parts_of(text, CHUNK)]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                yield self.numbers(texts)


def laid_out(ids: np.ndarray, lengths: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts as one stream of whole blocks padded with -1, each text's first block, whether a block is of a text)."""
    blocks = -(-lengths // BLOCK)
    base = np.cumsum(blocks + gap) - (blocks + gap)
    inside = np.repeat(np.tile([True, False], len(lengths)), np.stack([blocks, np.full(len(lengths), gap)], axis=1).ravel())
    stream = np.full(len(inside) * BLOCK, -1, dtype=np.int32)
    stream[np.arange(len(ids)) + np.repeat(base * BLOCK - (np.cumsum(lengths) - lengths), lengths)] = ids
    return stream, base, inside


def _block_words(batches, number):
    numbering = Numbering(number)
    seen, blocks = np.zeros(len(number), dtype=np.int64), 0
    for b in batches:
        for ids, lengths in numbering.of(b.column(0)):
            rows = np.sort(laid_out(ids, lengths, 0)[0].reshape(-1, BLOCK), axis=1)
            new = rows >= 0
            new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            seen += np.bincount(rows[new], minlength=len(number))
            blocks += len(rows)
    found = np.flatnonzero(seen)
    pa.default_memory_pool().release_unused()
    yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([blocks, *seen[found]], pa.int64())], ["word", "n"])


def block_frequencies(docs: DataFrame, number: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many blocks of all documents each vocabulary word is, and how many blocks there are."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _block_words(batches, shared.value), "word int, n long")
    out, blocks = np.zeros(len(number), dtype=np.int64), 0
    for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            blocks = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, blocks


def _sparse_times(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray | None, count: int, dense: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix in (row, column, value) form, rows ascending, with a dense one; no weights: ones."""
    out = np.zeros((count, dense.shape[1]), dtype=np.float32)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    low = 0
    while low < len(starts):
        # whole rows, about STEP_WORDS entries at a time
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + STEP_WORDS)))
        first, last = starts[low], starts[high] if high < len(starts) else len(rows)
        part = dense[ids[first:last]]
        if weights is not None:
            part *= weights[first:last, None]
        out[rows[starts[low:high]]] = np.add.reduceat(part, starts[low:high] - first, axis=0)
        low = high
    return out


def _gram(rows, ids, weights, count, basis) -> np.ndarray:
    """A^T (A basis) for the rows given in sparse form."""
    y = _sparse_times(rows, ids, weights, count, basis)
    order = np.argsort(ids, kind="stable")
    return _sparse_times(ids[order], rows[order], weights[order], len(basis), y)


@dataclass
class Index:
    """Latent space, passages and their vectors.

    ``number`` numbers every word of the passages, ``seen`` has the blocks each is in; ``kept`` leads from those numbers
    to the rows of the space, -1 for words that carry no evidence. ``space`` holds the words' weights already.
    """

    passages: list[Passage]
    number: dict[str, int]
    seen: np.ndarray
    kept: np.ndarray
    space: np.ndarray
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def project(self, places: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
        return _sparse_times(places, ids, None, count, self.space)


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    total = sum(np.frombuffer(x, dtype="<f4").astype(float) for x in table.column("part").to_pylist())
    return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _fit(docs: DataFrame, found: list[Passage], number: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF blocks of the sample and the passages.

    A pass is one job: each task multiplies its blocks with the basis, and the products are added up by slices of rows
    on the executors; the driver gets one matrix.
    """
    spark = docs.sparkSession
    size = len(number)
    rank = min(size, len(found) + OVERSAMPLE)
    width = min(size, rank + OVERSAMPLE)
    own = [(r, number[w]) for r, p in enumerate(found) for w in p.words if w in number]
    own_rows, own_ids = np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own], dtype=np.int64)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).distinct()
    chosen = staged(known.orderBy("h", "doc_id").limit(FIT_DOCUMENTS).select("doc_id"), "decontamination-ids")
    sample = staged(one_text_each(docs, chosen, "doc_id").select("text").repartition(FIT_PARTITIONS), "decontamination-sample")
    rows_each = max(1, SLICE // width)

    def pass_over(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((number, idf, basis))

        def run(batches):
            from pyspark import TaskContext

            number, idf, basis = shared.value
            numbering, total, place = Numbering(number), np.zeros(basis.shape), TaskContext.get().partitionId()
            for b in batches:
                for ids, lengths in numbering.of(b.column(0)):
                    stream = laid_out(ids, lengths, 0)[0]
                    hit = np.flatnonzero(stream >= 0)
                    total += _gram(hit // BLOCK, stream[hit], idf[stream[hit]], len(stream) // BLOCK, basis)
            for k, first in enumerate(range(0, len(total), rows_each)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "place": pa.array([place], pa.int32()), "part": pa.array([total[first : first + rows_each].astype("<f4").tobytes()], pa.binary())})

        total = _gram(own_rows, own_ids, idf[own_ids] * np.float32(PASSAGE_WEIGHT), len(found), basis).astype(float)
        sums = sample.mapInArrow(run, "slice int, place int, part binary").groupBy("slice").applyInArrow(_added, "slice int, part binary")
        for r in sums.collect():
            part = np.frombuffer(r["part"], dtype="<f4").reshape(-1, width)
            total[r["slice"] * rows_each : r["slice"] * rows_each + len(part)] += part
        shared.unpersist()
        return total

    basis = np.random.default_rng(42).standard_normal((size, width)).astype(np.float32)
    for _ in range(1 + POWER_PASSES):
        basis = np.linalg.qr(pass_over(basis))[0].astype(np.float32)
    small = basis.T.astype(float) @ pass_over(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis.astype(float) @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def build_index(docs: DataFrame, found: list[Passage]) -> Index | None:
    words = sorted({w for p in found for w in p.words})
    if not words:
        return None
    number = {w: k for k, w in enumerate(words)}
    seen, blocks = block_frequencies(docs, number)
    keep = {words[k] for k in np.flatnonzero(seen <= COMMON * blocks)}
    for p in found:
        keep.update(sorted(set(p.words), key=lambda w: (seen[number[w]], w))[:KEPT_PER_PASSAGE])
    kept = sorted(keep)
    idf = np.array([np.log((blocks + 1) / (seen[number[w]] + 1)) + 0.01 for w in kept], dtype=np.float32)
    inner = {w: k for k, w in enumerate(kept)}
    place = np.array([inner.get(w, -1) for w in words], dtype=np.int32)
    index = Index(found, number, seen, place, _fit(docs, found, inner, idf) * idf[:, None])
    own = [(r, inner[w]) for r, p in enumerate(found) for w in p.words if w in inner]
    rows, ids = np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own], dtype=np.int64)
    vectors = index.project(rows, ids, len(found))
    index.lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    index.vectors = vectors / index.lengths[:, None]
    return index


class Pattern:
    """A word sequence prepared for its longest common subsequence with others, by bit-parallel dynamic programming."""

    def __init__(self, words: list[int]):
        self.size, self.masks = len(words), {}
        for k, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << k

    def common(self, words: list[int], least: int = 0) -> int:
        """The length of the longest common subsequence; 0 if it can't reach ``least``."""
        hits = [m for m in map(self.masks.get, words) if m]
        if len(hits) < least:
            return 0
        row = full = (1 << self.size) - 1
        for m in hits:
            hit = row & m
            row = (row + hit | row - hit) & full
        return self.size - row.bit_count()


class RareWords:
    """Which windows can pass the check for a passage, by how many of its rarest words are in and around them.

    The check lets at most ``absent`` of a passage's words be missing. So of any set of its different words at most
    that many are missing, and the rest of the set must be there. Repeats in the text only raise the count.
    """

    def __init__(self, sequences: list[list[int]], seen: np.ndarray):
        lists: list[list[int]] = [[] for _ in range(len(seen))]
        self.needed = np.zeros(len(sequences), dtype=np.int32)
        self.words = [set(x) for x in sequences]
        self.all_needed = []
        for p, x in enumerate(sequences):
            absent = len(x) - next(n for n in range(len(x) + 1) if n / len(x) >= PARAPHRASE)
            rarest = sorted(self.words[p], key=lambda w: (seen[w], w))[: absent + SPARE_WORDS]
            self.needed[p] = max(1, len(rarest) - absent)
            self.all_needed.append(len(self.words[p]) - absent)
            for w in rarest:
                lists[w].append(p)
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.passages = np.array([p for x in lists for p in x], dtype=np.int32)

    def pairs(self, stream: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """window * number of passages + passage, ascending, where the window and a block on either side hold enough."""
        at = np.flatnonzero(stream >= 0)
        sizes = self.sizes[stream[at]]
        steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = self.passages[np.repeat(self.starts[stream[at]], sizes) + steps]
        # each passage's rare words in the order of the stream: enough of them within four blocks is a find
        order = np.argsort(found, kind="stable")
        found, block = found[order], np.repeat(at // BLOCK, sizes)[order]
        first = np.arange(len(found))
        last = first + self.needed[found] - 1
        first, last = first[last < len(found)], last[last < len(found)]
        near = (found[first] == found[last]) & (block[last] - block[first] <= 3)
        first, last = first[near], last[near]
        reach = 4 - (block[last] - block[first])
        window = np.repeat(block[last] - 2, reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        passage = np.repeat(found[first], reach)
        kept = (window >= 0) & inside[window]
        return np.unique(window[kept] * len(self.needed) + passage[kept])

    def able(self, p: int, different: set[int]) -> bool:
        """Whether these words hold enough of all the passage's different words."""
        return len(self.words[p] & different) >= self.all_needed[p]


@dataclass
class Hit:
    item_id: int
    part: int
    cosine: float
    lcs: float
    answer: float
    word_start: int


class Searcher:
    """Finds the passages in texts; one in each worker."""

    def __init__(self, index: Index, exact: bool = False):
        self.index, self.numbering, self.exact = index, Numbering(index.number), exact
        sequences = [[index.number[w] for w in p.words] for p in index.passages]
        self.patterns = [Pattern(x) for x in sequences]
        self.answers = [set(x[-ANSWER_WORDS:]) for x in sequences]
        self.targets = np.ascontiguousarray(index.vectors.T)
        # a window that holds a passage holds this many of its words with evidence
        fewest = min(sum(index.kept[w] >= 0 for w in x) for x in sequences)
        self.least = max(1, min(LEAST_KNOWN, int(np.ceil(CONTAINED * fewest))))
        self.rare = RareWords(sequences, index.seen)

    def _latent(self, stream: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the blocks, windows with enough words that carry evidence)."""
        rows = np.where(stream >= 0, self.index.kept[stream], -1)
        hit = np.flatnonzero(rows >= 0)
        known = np.bincount(hit // BLOCK, minlength=len(inside))
        known[:-1] += known[1:].copy()
        return self.index.project(hit // BLOCK, rows[hit], len(inside)), np.flatnonzero((known >= self.least) & inside)

    def _close(self, blocks: np.ndarray, able: np.ndarray) -> np.ndarray:
        """window * number of passages + passage, ascending, of windows near a passage."""
        width = self.targets.shape[1]
        step, out = max(1, STEP_COSINES // width), [np.zeros(0, dtype=np.int64)]
        for s in range(0, len(able), step):
            k = able[s : s + step]
            windows = blocks[k] + blocks[k + 1]
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            bar = np.maximum(COSINE * np.maximum(norms, 1e-9)[:, None], (CONTAINED * self.index.lengths)[None, :])
            r, p = np.nonzero(windows @ self.targets >= bar)
            out.append(k[r] * width + p)
        return np.concatenate(out)

    def _hits(self, stream: np.ndarray, base: np.ndarray, inside: np.ndarray) -> list[list[Hit]]:
        """The best hit of each item in each text of a stream, the vectors of STEP_BLOCKS blocks at a time."""
        width, best = len(self.patterns), {}
        counted = self.rare.pairs(stream, inside) if self.exact else np.zeros(0, dtype=np.int64)
        for first in range(0, len(inside), STEP_BLOCKS):
            # a window is a block and the next one; the last blocks of a stream are in no text
            stop = min(first + STEP_BLOCKS + 1, len(inside))
            own = inside[first:stop].copy()
            own[STEP_BLOCKS:] = False
            blocks, able = self._latent(stream[first * BLOCK : stop * BLOCK], own)
            low, high = np.searchsorted(counted, [first * width, (first + STEP_BLOCKS) * width])
            pairs = np.union1d(self._close(blocks, able) + first * width, counted[low:high])
            self._check(pairs, blocks, first, stream, base, best)
        out: list[list[Hit]] = [[] for _ in base]
        for text, item_id in sorted(best):
            out[text].append(best[text, item_id])
        return out

    def _check(self, pairs: np.ndarray, blocks: np.ndarray, first: int, stream: np.ndarray, base: np.ndarray, best: dict) -> None:
        """Puts what holds its passage into ``best``; ``blocks`` are the vectors from block ``first`` on."""
        window, passage = pairs // len(self.patterns), pairs % len(self.patterns)
        last, words, different, text = -1, [], set(), 0
        for k, p in zip(window.tolist(), passage.tolist(), strict=True):
            if k != last:
                last, words = k, stream[max(0, (k - 1) * BLOCK) : (k + 3) * BLOCK].tolist()
                different, text = set(words), int(np.searchsorted(base, k, "right")) - 1
            if not self.rare.able(p, different):
                continue
            pattern, item = self.patterns[p], self.index.passages[p]
            held = len(self.answers[p] & different) / len(self.answers[p])
            least = PARAPHRASE if held >= ANSWER else VERBATIM
            lcs = pattern.common(words, int(least * pattern.size)) / pattern.size
            if lcs < least:
                continue
            around = blocks[k - first] + blocks[k - first + 1]
            cosine = float(around @ self.index.vectors[p] / max(np.linalg.norm(around), 1e-9))
            old = best.get((text, item.item_id))
            if old is None or (lcs, cosine) > (old.lcs, old.cosine):
                best[text, item.item_id] = Hit(item.item_id, item.part, cosine, lcs, held, (k - int(base[text])) * BLOCK)

    def found(self, column: pa.Array) -> Iterator[list[Hit]]:
        """The best hit of each item in each text of a column, in order."""
        for ids, lengths in self.numbering.of(column):
            yield from self._hits(*laid_out(ids, lengths, GAP))

    def hits(self, text: str | None) -> list[Hit]:
        return next(self.found(pa.array([text], pa.string())))


def _scans(docs: DataFrame, benchmark: DataFrame):
    """A broadcast index for each PASSAGES_PER_SCAN passages of the benchmark; the driver holds one scan's passages."""

    def index(found):
        made = build_index(docs, found)
        return [docs.sparkSession.sparkContext.broadcast(made)] if made else []

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found: list[Passage] = []
    for r in items.orderBy("item_id", "text").toLocalIterator():
        found += passages([(r["item_id"], r["text"])])
        while len(found) >= PASSAGES_PER_SCAN:
            yield from index(found[:PASSAGES_PER_SCAN])
            found = found[PASSAGES_PER_SCAN:]
    yield from index(found)


_HITS = "doc_id long, item_id long, cosine double, lcs double, answer double, word_start long"


def contaminated(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, word_start: one row per document and benchmark item found in it.

    lcs: share of the passage's words in the common subsequence; answer: share of its closing words present;
    word_start: about where. Null or empty text: no row. Null doc_id: null in the row. Repeated rows are repeated.
    Other columns are ignored; an empty table, or a benchmark without words, gives an empty result. ``exact``: with
    candidates by rare words beside the latent search.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for shared in _scans(docs, benchmark):

        def run(batches, shared=shared):
            search = Searcher(shared.value, exact)
            for b in batches:
                rows = [(d, h.item_id, h.cosine, h.lcs, h.answer, h.word_start) for d, found in zip(b.column(0).to_pylist(), search.found(b.column(1)), strict=True) for h in found]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _HITS.split(", ")])
            pa.default_memory_pool().release_unused()

        hits = found.mapInArrow(run, _HITS)
        result = hits if result is None else result.unionByName(hits)
    return docs.sparkSession.createDataFrame([], _HITS) if result is None else result


def decontaminated(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose text no benchmark passage was found."""
    for shared in _scans(docs, benchmark):

        def run(batches, shared=shared):
            search = Searcher(shared.value, exact)
            for b in batches:
                clean = [not found for found in search.found(b.column(b.num_columns - 1))]
                yield b.filter(pa.array(clean, pa.bool_())).select(range(b.num_columns - 1))
            pa.default_memory_pool().release_unused()

        docs = docs.withColumn(fresh(docs, "searched"), F.col("text").cast("string")).mapInArrow(run, StructType(docs.schema.fields))
    return docs
