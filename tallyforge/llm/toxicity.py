"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are the distinct texts of labelled documents outside the held-out part; where there are more than ``EXAMPLES``,
about that many are taken by a hash of the id, and again of the text. That bound is the only sample: it keeps fitting,
index and broadcast of fixed size. Terms are runs of letters, lower-cased, and their beginnings of three to seven letters.
All terms of the examples count, weighted by inverse document frequency over the whole corpus and by relevance: how
much their log odds among toxic examples, less one standard error, exceed 1.4 times the odds among the others; a term
that does not reach that weighs nothing.

The index is inverted: per term, postings in blocks of ``BLOCK`` examples with the block's greatest weight. A query
bounds each block by its weights times these maxima, visits blocks from the greatest bound down and stops when no
block can beat its k-th neighbour, so the neighbours are exact; of equal ones the earlier entry is nearer, and examples with equal
vectors are one entry that counts as often. The vote is the sum of the toxic neighbours' similarities over k, so far
neighbours and missing ones count for nothing. A table made by leaving each example out turns votes into scores.

A document without any weighing term gets the training share of such documents. Null and empty texts are such
documents. Labels of null are ignored; of several labels for an id or a text the highest counts. Repeated rows score alike.
Other columns, whatever their names, are ignored. Texts are read in slices of bounded size, long ones whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import held_out, sliced, written

PARTS, HELD = 3, 1
EXAMPLES = 20_000
NEIGHBOURS, BLOCK = 25, 64
CUT = 0.7
#: Votes below this are alike.
LEAST_VOTE = 1e-3
PREFIXES, MEMO = (3, 4, 5, 6, 7), 150_000
#: Log odds that a term must exceed, standard errors that are taken off them, and blocks that a query visits first.
LEAST, ERRORS, FIRST = math.log(1.4), 1.0, 8
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word and its beginnings, each marked as such: inflected and compound forms share those."""
    return [word, *[f"^{word[:k]}" for k in PREFIXES if len(word) > k]]


class Terms:
    """Numbers and weights of the terms: vectors of texts; words met before need one look-up."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.weights = weights
        self.words: dict[str, int] = {}
        self.begins: dict[int, dict[str, int]] = {k: {} for k in PREFIXES}
        for i, t in enumerate(terms):
            if t[0] == "^":
                self.begins[len(t) - 1][t[1:]] = i
            else:
                self.words[t] = i
        self.known: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        found = [i for k, begins in self.begins.items() if len(word) > k and (i := begins.get(word[:k])) is not None]
        whole = self.words.get(word)
        return tuple(found) if whole is None else (whole, *found)

    def numbers(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of a text that weigh something, and how often each comes."""
        found: list[int] = []
        if text:
            known = self.known
            for word in WORD.findall(text.lower()):
                held = known.get(word)
                if held is None:
                    if len(known) >= MEMO:
                        known.clear()
                    held = known[word] = self._of_word(word)
                if held:
                    found += held
        return np.unique(np.array(found, dtype=np.int64), return_counts=True)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of a text by its terms and their counts: terms and weights."""
        raw = (1 + np.log(counts)) * self.weights[terms]
        size = math.sqrt(math.fsum(raw * raw))
        return (terms, raw / size) if size else (terms[:0], raw[:0])


class Index:
    """Block-max inverted index over example vectors (terms and weights, of unit length)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list, k: int = NEIGHBOURS, block: int = BLOCK):
        # Equal vectors become one entry with counts; entries with the same strongest terms stand together, which
        # sharpens the bounds.
        entries: dict[tuple, list] = {}
        self.entry_of = []
        for (terms, weights), label, i in zip(vectors, toxic, ids):
            strongest = tuple(terms[np.lexsort((terms, -weights))][:4].tolist())
            entry = entries.setdefault((strongest, terms.tobytes(), weights.tobytes()), [0, 0, i, terms, weights])
            entry[0] += 1
            entry[1] += label
            entry[2] = min(entry[2], i)
            self.entry_of.append(entry)
        order = [entries[e] for e in sorted(entries)]
        for at, entry in enumerate(order):
            entry.append(at)
        self.entry_of = [entry[5] for entry in self.entry_of]
        self.k, self.block, self.blocks = k, block, -(-len(order) // block)
        self.total = np.array([e[0] for e in order], dtype=np.int64)
        self.toxic = np.array([e[1] for e in order], dtype=np.int64)
        self.ids = [e[2] for e in order]
        terms = np.concatenate([e[3] for e in order]) if order else np.empty(0, np.int64)
        weights = np.concatenate([e[4] for e in order]).astype(np.float32) if order else np.empty(0, np.float32)
        where = np.repeat(np.arange(len(order), dtype=np.int32), [len(e[3]) for e in order])
        by_term = np.lexsort((where, terms))
        self.weights, self.where = weights[by_term], where[by_term]
        self.terms = np.searchsorted(terms[by_term], np.arange((int(terms.max()) if len(terms) else -1) + 2)).astype(np.int32)  # each term's first posting
        self._derive()

    def _derive(self) -> None:
        """Runs of postings of one term in one block: first posting, block, greatest weight; and each term's first run."""
        terms, part = np.repeat(np.arange(len(self.terms) - 1), np.diff(self.terms)), self.where // self.block
        first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (part[1:] != part[:-1])])) if len(terms) else np.empty(0, np.int64)
        self.runs, self.run_block = np.append(first, len(terms)), part[first]
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        self.term_runs = np.searchsorted(terms[first], np.arange(len(self.terms)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("runs", "run_block", "most", "term_runs", "entry_of")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._derive()

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of all entries in a row: where each begins, terms and weights."""
        by_entry = np.argsort(self.where, kind="stable")
        terms = np.repeat(np.arange(len(self.terms) - 1), np.diff(self.terms))[by_entry]
        return np.searchsorted(self.where[by_entry], np.arange(len(self.total) + 1)), terms, self.weights[by_entry].astype(np.float64)

    @staticmethod
    def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ranges in a row, and which range each is of."""
        sizes = last - first
        whose = np.repeat(np.arange(len(first)), sizes)
        return np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes), whose

    def nearest(self, query: tuple[np.ndarray, np.ndarray], without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities, entries and examples counted, from the nearest down, k examples in all; ties go to the lower
        entry. ``without``: an entry of which one example is left out."""
        terms, weights = query
        have = terms < len(self.term_runs) - 1
        terms, weights = terms[have], weights[have]
        runs, whose = self._spread(self.term_runs[terms], self.term_runs[terms + 1])
        weights = weights[whose]
        blocks = self.run_block[runs]
        bound = np.bincount(blocks, weights=weights * self.most[runs], minlength=self.blocks)
        # First the blocks of the greatest bounds; their k-th neighbour tells which others can matter.
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bound, min(FIRST, self.blocks) - 1)[:FIRST]] = True
        entries, scores = self._scored(runs, weights, first[blocks])
        floor = self._floor(scores)
        more = ~first & (bound >= floor - 1e-11) & (bound > 0)
        if more.any():
            others, theirs = self._scored(runs, weights, more[blocks])
            entries, scores = np.concatenate([entries, others]), np.concatenate([scores, theirs])
            floor = self._floor(scores)
        near = np.flatnonzero((scores >= floor) & (scores > 0))
        entries, scores = entries[near], scores[near]
        order = np.lexsort((entries, -scores))
        entries, scores = entries[order], scores[order]
        counts = self.total[entries] - (entries == without)
        taken = np.minimum(counts, np.maximum(0, self.k - (np.cumsum(counts) - counts)))
        return scores[taken > 0], entries[taken > 0], taken[taken > 0]

    def _scored(self, runs: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries in the wanted runs and their similarities; an entry is in one block, so it is whole."""
        runs = runs[wanted]
        postings, which = self._spread(self.runs[runs], self.runs[runs + 1])
        where, found = self.where[postings], weights[wanted][which] * self.weights[postings]
        order = np.argsort(where, kind="stable")
        where = where[order]
        fresh = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.empty(0, np.int64)
        # Rounded, so that ties do not hang on the order of sums.
        return where[fresh].astype(np.int64), np.round(np.add.reduceat(found[order], fresh), 12) if len(fresh) else np.empty(0)

    def _floor(self, scores: np.ndarray) -> float:
        """A similarity that the k-th example reaches, one of them perhaps left out; zero where there are fewer."""
        return float(np.partition(scores, len(scores) - self.k - 1)[len(scores) - self.k - 1]) if len(scores) > self.k else 0.0

    def vote(self, query: tuple[np.ndarray, np.ndarray], without: tuple[int, int] | None = None) -> tuple[float, np.ndarray]:
        """The toxic neighbours' similarities over k, and the nearest entries; ``without``: the entry and the label of
        an example that is left out."""
        scores, entries, taken = self.nearest(query, None if without is None else without[0])
        total, toxic = self.total[entries], self.toxic[entries]
        if without is not None:
            own = entries == without[0]
            total, toxic = total - own, toxic - own * without[1]
        return math.fsum(scores * taken * toxic / total) / self.k, entries


def _term_counts(texts: DataFrame) -> DataFrame:
    """term, n and toxic (rows and toxic rows that hold it) of rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        bad: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([bad[t] for t in n], pa.int64())], names=["term", "n", "toxic"])
            n.clear()
            bad.clear()
            return rows

        for batch in sliced(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = {f for w in set(WORD.findall(text.lower())) for f in features(w)} if text else set()
                n.update(held)
                if toxic:
                    bad.update(held)
                if len(n) > 200_000:
                    yield out()
        yield out()

    return texts.select("text", "toxic").mapInArrow(run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _numbered(docs: DataFrame, terms) -> DataFrame:
    """doc_id, and the numbers t and counts c of the terms (of a broadcast ``Terms``) in each row's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in sliced(batches, "text"):
            found = [known.numbers(text.as_py()) for text in batch.column(1)]
            edges = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "t", "c"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, t array<int>, c array<int>")


def _frequencies(numbered: DataFrame, terms: int) -> DataFrame:
    """number and n (rows that hold it) of the terms, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], names=["number", "n"])

    return numbered.select("t").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def relevance(terms: DataFrame, n: int, bad: int) -> DataFrame:
    """term and relevance of the rows (term, n, toxic) whose log odds among ``bad`` toxic of ``n`` texts exceed those
    among the others by more than ``ERRORS`` standard errors and ``LEAST``; counts are raised by one half."""
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    c, d = F.lit(bad + 1.0) - a, F.lit(n - bad + 1.0) - b
    odds = F.log(a) - F.log(c) - F.log(b) + F.log(d)
    return terms.filter("toxic > 0").select("term", (odds - ERRORS * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d) - LEAST).alias("relevance")).filter("relevance > 0")


def examples_of(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id (the least), text and toxic of the distinct labelled texts outside the held-out part, about ``most``."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = written(marks.filter(~held_out(F.col("doc_id"), PARTS, HELD)))

    def share(rows: DataFrame, column: str) -> DataFrame:
        """A fixed share by hash: about ``most`` rows, however many there are."""
        n = rows.count()
        return rows.filter(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int((1 << 30) * (most / n))) if n > most else rows

    # Bounded by ``most``, so the labels go to the texts and no text is shuffled but these.
    train = docs.select("doc_id", "text").join(F.broadcast(share(marks, "doc_id")), "doc_id")
    return share(written(train.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))), "text")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = EXAMPLES) -> dict:
    """Index, terms and calibration, all of bounded size."""
    spark = docs.sparkSession
    train = examples_of(docs, labels, max_examples)
    n, bad = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    empty = {"model": None, "prior": (bad + 0.0) / n if n else 0.0, "bins": None}
    if not n or not bad or bad == n:  # nothing to tell apart
        return empty
    told = relevance(_term_counts(train), n, bad).orderBy("term").toArrow()  # of the bounded examples
    if not told.num_rows:
        return empty
    terms = Terms(told["term"].to_pylist(), told["relevance"].to_numpy())
    numbered = written(_numbered(docs, spark.sparkContext.broadcast(terms)))  # the texts are read once
    frequency = _frequencies(numbered, len(terms.weights)).toArrow()
    rows = np.zeros(len(terms.weights))
    rows[frequency["number"].to_numpy()] = frequency["n"].to_numpy()
    terms.weights = terms.weights * (np.log((numbered.count() + 1) / (rows + 1)) + 1)
    sent = spark.sparkContext.broadcast(terms)  # as many strings as the examples have terms

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [sent.value.vector(*sent.value.numbers(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v[0] for v in found], pa.list_(pa.int64())), pa.array([v[1] for v in found], pa.list_(pa.float64()))], names=["doc_id", "toxic", "t", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = train.select("doc_id", "text", "toxic").mapInArrow(vectors, f"doc_id {kind}, toxic int, t array<long>, w array<double>").orderBy("doc_id", "toxic").toArrow().combine_chunks()
    toxic = found["toxic"].to_pylist()
    whole = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(found["t"], found["w"])]
    bare = [x for x, v in zip(toxic, whole) if not len(v[0])]
    prior = (sum(bare) + bad / n) / (len(bare) + 1)
    rows_told = [k for k, v in enumerate(whole) if len(v[0])]
    ids = found["doc_id"].to_pylist()
    index = Index([whole[k] for k in rows_told], [toxic[k] for k in rows_told], [ids[k] for k in rows_told])
    model = spark.sparkContext.broadcast((index, Terms([], terms.weights)))  # the words themselves are done with
    return {"model": model, "prior": prior, "bins": _calibrated(spark, model, len(index.total), bad / n), "numbered": numbered}


def _calibrated(spark, model, entries: int, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the toxic share there, from each example when it is left out, made monotone; worked out by the
    executors. The steps of the isotonic regression, each at its mean vote, their shares drawn a little to the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value[0]
        starts, terms, weights = index.vectors()
        for batch in batches:
            found = []
            for k in batch.column(0).to_pylist():
                query = slice(starts[k], starts[k + 1])
                for label, n in ((1, int(index.toxic[k])), (0, int(index.total[k] - index.toxic[k]))):
                    if n:
                        found.append((index.vote((terms[query], weights[query]), (k, label))[0], label, n))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))], names=["vote", "toxic", "n"])

    votes = spark.range(0, entries, 1, max(1, entries // 500)).mapInArrow(run, "vote double, toxic long, n long").toArrow()
    vote, n = np.round(votes["vote"].to_numpy(), 9), votes["n"].to_numpy().astype(float)
    levels, level = np.unique(vote, return_inverse=True)
    total, hit = np.bincount(level, weights=n), np.bincount(level, weights=n * votes["toxic"].to_numpy())
    rates = _monotone(hit / total, total)  # isotonic: levels with one rate are one step
    step = np.cumsum(np.concatenate([[0], rates[1:] != rates[:-1]])) if len(rates) else np.empty(0, np.int64)
    count, hits, mean = (np.bincount(step, weights=w) for w in (total, hit, total * levels))
    return mean / count, (hits + 0.5 * base) / (count + 0.5)


def _monotone(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pooled so that no bin is below the one before."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            r1, w1, n1 = pools.pop()
            r0, w0, n0 = pools.pop()
            pools.append([(r0 * w0 + r1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([[r] * int(n) for r, _, n in pools])


def calibrated(vote: float, bins: tuple[np.ndarray, np.ndarray]) -> float:
    """The score of a vote: between the votes of the table the odds grow as a power of the vote."""
    votes, rates = bins
    odds = np.interp(math.log(max(vote, LEAST_VOTE)), np.log(np.maximum(votes, LEAST_VOTE)), np.log(rates / (1 - rates)))
    return 1 / (1 + math.exp(-odds))


def score(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of up to three nearest examples) of every row."""
    fitted = fit(docs, labels, **bounds)
    model, prior, bins = fitted["model"], fitted["prior"], fitted["bins"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, terms = model.value
        memo: dict[bytes, tuple[float, list]] = {}  # copies are many
        for batch in batches:
            starts, t, c = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().astype(np.int64), batch.column(2).values.to_numpy()
            scores, evidence = [], []
            for at, to in zip(starts, starts[1:]):
                key = t[at:to].tobytes() + c[at:to].tobytes()
                found = memo.get(key)
                if found is None:
                    if len(memo) >= 5_000:
                        memo.clear()
                    vector = terms.vector(t[at:to], c[at:to])
                    if len(vector[0]):
                        vote, near = index.vote(vector)
                        found = calibrated(vote, bins), [index.ids[e] for e in near[:3]]
                    else:
                        found = prior, []
                    memo[key] = found
                scores.append(found[0])
                evidence.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(batch.column(0).type))], names=["doc_id", "score", "evidence"])

    if model is None:
        out = docs.select("doc_id", F.lit(float(prior)).alias("score"), F.array().cast(f"array<{kind}>").alias("evidence"))
    else:
        out = fitted["numbered"].mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "evidence")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
