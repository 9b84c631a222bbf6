"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata.

Terms are whole words and word beginnings that toxic documents have far more
often than clean ones. A deterministic automaton, built lazily from the trie and
the Levenshtein automaton of one edit, reads each distinct word of a text once and
mostly dies after a few characters. Hits inside quotations or reported speech
count less."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import drop_written, id_remainder, table, written

#: At most this many labelled rows, chosen by a hash of their ids, teach the lexicon and the score.
SAMPLE_ROWS = 20_000
#: Letters of the word beginnings that may become terms, and of words that may be misspelled.
PREFIX_LETTERS, FUZZY_LETTERS = (4, 7), 5
#: A term is in this many toxic rows at least.
MIN_ROWS = 3
#: Parts of the sample for cross-validation.
FOLDS = 3
MOST_WEIGHT = 6.0
#: How much a quoted hit counts, without and with a word of reporting nearby.
QUOTED, REPORTED = 0.6, 0.4
CONTEXT_CHARS = 80
WORDS = re.compile(r"[^\W\d_]+")
OPEN, CLOSE = "“«„‘", "”»“’"
#: Words of reporting.
REPORTING = frozenset("said says wrote writes called quoted quote reported according dit écrit appelle selon sagte schrieb nannte laut dijo escribió llamó según".split())


@dataclass(frozen=True)
class Strictness:
    """A term is in this share of toxic rows, so much likelier there than in clean ones,
    at this significance (G2)."""

    share: float
    ratio: float
    g2: float


#: What cross-validation chooses from, the strictest first. Few terms in many rows ask
#: for a strict rule, many terms in a few rows each for a loose one.
GRID = (Strictness(0.02, 25, 25), Strictness(0, 25, 25), Strictness(0, 25, 15), Strictness(0, 10, 15))


class Automaton:
    """The trie of the terms x the Levenshtein automaton, made deterministic as words are read.

    An item of a state is (node, edits left). Word terms of FUZZY_LETTERS letters or
    more are also in a second trie that starts with one edit."""

    def __init__(self, words: list[str], prefixes: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}, {}]
        self.word_at: dict[int, str] = {}
        self.prefix_at: dict[int, str] = {}
        for w in words:
            self.word_at[self._add(0, w)] = w
            if len(w) >= FUZZY_LETTERS:
                self.word_at[self._add(1, w)] = w
        for p in prefixes:
            self.prefix_at[self._add(0, p)] = p
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stops: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0), (1, 1)})

    def _add(self, node: int, term: str) -> int:
        for ch in term:
            if ch not in self.children[node]:
                self.children[node][ch] = len(self.children)
                self.children.append({})
            node = self.children[node][ch]
        return node

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a state after its closure over skipped characters; -1 if it is empty."""
        every = set(items)
        for node, left in items:
            if left:
                every |= {(c, left - 1) for c in self.children[node].values()}
        key = frozenset((n, e) for n, e in every if e or (n, 1) not in every)
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            exact = sorted(self.prefix_at[n] for n, _ in key if n in self.prefix_at)
            self.stops.append((exact[0], 0) if exact else None)
            ends = sorted((1 if e == 0 and self._fuzzy(n) else 0, self.word_at[n]) for n, e in key if n in self.word_at)
            self.accepts.append((ends[0][1], ends[0][0]) if ends else None)
        return self.ids[key]

    def _fuzzy(self, node: int) -> bool:
        if not hasattr(self, "_inside"):
            self._inside, todo = set(), [1]
            while todo:
                n = todo.pop()
                self._inside.add(n)
                todo += self.children[n].values()
        return node in self._inside

    def _move(self, state: int, ch: str) -> int:
        items = set()
        for node, left in self.states[state]:
            if (c := self.children[node].get(ch)) is not None:
                items.add((c, left))
            if left:
                items.add((node, left - 1))
                items |= {(x, left - 1) for x in self.children[node].values()}
        found = self.moves[state][ch] = self._state(items)
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) that the word is, or begins with; None for other words."""
        state, moves, stops = self.start, self.moves, self.stops
        for ch in word:
            nxt = moves[state].get(ch)
            if nxt is None:
                nxt = self._move(state, ch)
            if nxt < 0:
                return None
            if stops[nxt]:
                return stops[nxt]
            state = nxt
        return self.accepts[state]


def terms_of(text: str) -> set[str]:
    """The words of a text, and with '*' the beginnings of its words."""
    words = set(WORDS.findall(text.lower()))
    low, high = PREFIX_LETTERS
    return words | {w[:n] + "*" for w in words for n in range(low, min(high, len(w)) + 1)}


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    harmless: frozenset = frozenset()
    fuzzy_weight: float = 0.0
    slope: float = 1.0
    offset: float = -2.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self) -> Automaton:
        if "_automaton" not in self.__dict__:
            self._automaton = Automaton([t for t in self.weights if t[-1] != "*"], [t[:-1] for t in self.weights if t[-1] == "*"])
        return self._automaton

    def hits(self, text: str) -> dict[str, tuple[str, int]]:
        """word -> (term, edits) for the words of a lower-case text that match."""
        match = self.automaton().match
        found = ((w, match(w)) for w in set(WORDS.findall(text)))
        return {w: m for w, m in found if m and not (m[1] and w in self.harmless)}

    def evidence(self, text: str) -> float:
        low = text.lower()
        hits = self.hits(low)
        if not hits:
            return 0.0
        best: dict[tuple[str, int], float] = {}
        for m in WORDS.finditer(low):
            if hit := hits.get(m[0]):
                best[hit] = max(best.get(hit, 0.0), context(low, m.start(), m.end()) if best.get(hit, 0) < 1 else 1.0)
        kinds = Counter(hits.values())  # different words that begin so, or that are misspelled so
        total = 0.0
        for (term, edits), share in sorted(best.items()):
            weight = self.weights.get(term, self.weights.get(term + "*", 0.0))
            total += share * (min(weight, self.fuzzy_weight) if edits else weight * (1 + math.log2(kinds[term, edits])))
        return total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.evidence(t) if t else 0.0 for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def context(text: str, start: int, end: int) -> float:
    """How much a hit counts: less between quotation marks, least if someone is quoted."""
    before, after = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    quoted = before.count('"') % 2 == 1 and '"' in after
    for a, b in zip(OPEN, CLOSE, strict=True):
        quoted = quoted or (before.rfind(a) > before.rfind(b) if a != b else a in before) and b in after
    if not quoted:
        return 1.0
    return REPORTED if REPORTING & set(WORDS.findall(before + " " + after)) else QUOTED


def counted(sample: DataFrame, wanted: frozenset | None, least: int) -> dict[str, np.ndarray]:
    """term -> in how many rows of each part of the sample it is, for the terms in `least` rows or more."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in it:
            for text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = terms_of(text)
                seen.update((t, fold) for t in (terms if shared.value is None else terms & shared.value))
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "fold", "n"])

    rows = sample.select("text", "fold").mapInArrow(batches, "term string, fold int, n long")
    each = rows.groupBy("term").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)])
    found = each.where(F.col("all") >= least).drop("all").toArrow()
    table = np.stack([found[f"n{f}"].to_numpy() for f in range(FOLDS)], 1)
    return dict(zip(found["term"].to_pylist(), table, strict=True))


def ratio(t: float, c: float, nt: int, nc: int) -> float:
    return math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))


def significance(t: int, c: int, nt: int, nc: int) -> float:
    """G2 of the two-by-two table."""
    n, total = t + c, nt + nc
    cells = ((t, n * nt / total), (c, n * nc / total), (nt - t, (total - n) * nt / total), (nc - c, (total - n) * nc / total))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o and e)


def choose(toxic: dict[str, int], clean: dict[str, int], nt: int, nc: int, strict: Strictness) -> dict[str, float]:
    """Weights of the lexicon's terms: of nested word beginnings the most significant one, or the
    word itself where it makes up most of what begins so."""
    least = max(MIN_ROWS, math.ceil(strict.share * nt))
    good = {t: min(MOST_WEIGHT, r) for t, n in toxic.items() if n >= least and (r := ratio(n, c := clean.get(t, 0), nt, nc)) >= math.log(strict.ratio) and significance(n, c, nt, nc) >= strict.g2}
    words = [t for t in good if t[-1] != "*"]
    prefixes = sorted((t for t in good if t[-1] == "*"), key=lambda t: (-significance(toxic[t], clean.get(t, 0), nt, nc), len(t), t))
    kept: dict[str, float] = {}
    chosen: list[str] = []
    for p in prefixes:
        if not any(p.startswith(q[:-1]) or q.startswith(p[:-1]) for q in chosen):
            chosen.append(p)
    whole = set()
    for w in words:
        over = [p for p in chosen if w.startswith(p[:-1])]
        if not over or toxic[w] >= 0.8 * toxic[over[0]]:
            kept[w] = good[w]
            whole |= set(over)
    return kept | {p: good[p] for p in chosen if p not in whole}


def fit_line(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic regression by Newton's method, with a small ridge,
    and its log loss."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (y - p)) - 0.01 * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    slope, offset = float(max(w[0], 0.05)), float(w[1])
    z = np.clip(slope * x + offset, -30, 30)
    return slope, offset, float((n * (np.log1p(np.exp(z)) - y * z)).sum())


def train(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn the lexicon, its weights, the harmless look-alikes and the score.

    Learns from at most sample_rows labelled rows (the first by a hash of the id);
    what comes to the driver is bounded by that sample. How strict the choice of terms
    is (GRID) is settled by cross-validation inside the sample: each part is scored with
    the terms of the others, and the log loss decides; ties go to the stricter. The score
    is fitted on the same points.

    Defined cases: copies of a text vote once; conflicting labels of an id or a text count
    as the largest; null labels, ids and texts are left out; labels without a document do
    not count; other columns of either table are ignored, whatever their names. Without
    toxic rows the lexicon is empty and every score is low."""
    known = labels.where(training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = texts.join(F.broadcast(picked), F.col("id") == F.col("_id")).select("text", "toxic")  # at most sample_rows ids
    votes = drawn.groupBy(F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))  # copies of a text vote once
    sample = written(votes.select("text", "toxic", F.pmod("_h", F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")
    size = {kind: np.zeros(FOLDS, np.int64) for kind in (0, 1)}
    for r in sample.groupBy("toxic", "fold").count().collect():
        size[r["toxic"]][r["fold"]] = r["count"]
    nt, nc = int(size[1].sum()), int(size[0].sum())
    if not nt:
        drop_written(sample)
        return ToxicityModel()
    # Terms in fewer toxic rows are not significant by the loosest rule even if no clean row has them.
    loosest = min(strict.g2 for strict in GRID)
    least = next((n for n in range(MIN_ROWS, nt) if significance(n, 0, nt, nc) >= loosest), MIN_ROWS)
    often = counted(sample.where("toxic = 1"), None, least)
    seldom = counted(sample.where("toxic = 0"), frozenset(often), 1)

    def lexicon(strict: Strictness, folds: list[int]) -> dict[str, float]:
        of = lambda table: {t: int(n[folds].sum()) for t, n in table.items()}
        return choose(of(often), of(seldom), int(size[1][folds].sum()), int(size[0][folds].sum()), strict)

    spark = docs.sparkSession
    tried = [[ToxicityModel(lexicon(strict, [f for f in range(FOLDS) if f != out])) for out in range(FOLDS)] for strict in GRID]
    shared_tried = spark.sparkContext.broadcast(tried)

    def evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for k, models in enumerate(shared_tried.value):
                x = [round(models[fold].evidence(text), 1) for text, _, fold in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array(x, pa.float64()), batch.column(1)], names=["k", "x", "toxic"])

    points = sample.select("text", "toxic", "fold").mapInArrow(evidence, "k int, x double, toxic int").groupBy("k", "x", "toxic").count().orderBy("k", "x", "toxic").collect()
    fits = []
    for k in range(len(GRID)):
        own = [r for r in points if r["k"] == k]
        fits.append(fit_line(np.array([r["x"] for r in own]), np.array([float(r["toxic"]) for r in own]), np.array([float(r["count"]) for r in own])))
    chosen = min(range(len(GRID)), key=lambda k: (round(fits[k][2], 6), k))
    strict = GRID[chosen]
    model = ToxicityModel(lexicon(strict, list(range(FOLDS))), slope=fits[chosen][0], offset=fits[chosen][1])
    shared = spark.sparkContext.broadcast(model)

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(w, y) for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, m in shared.value.hits(text.lower()).items() if m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["word", "toxic"])

    alike = sample.select("text", "toxic").mapInArrow(near, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    model.harmless = frozenset(r["word"] for r in alike if r["c"] and ratio(r["t"], r["c"], nt, nc) < math.log(strict.ratio))
    once = Counter(bool(r["t"]) for r in alike if r["t"] + r["c"] == 1)  # seen once: what unseen look-alikes are worth
    model.fuzzy_weight = min(max(ratio(once[True], once[False], nt, nc), 0.0), MOST_WEIGHT)
    drop_written(sample)
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row, 0 to 1.

    Narrow: a pass over Arrow batches against the broadcast lexicon. Defined cases:
    null and empty texts score as texts without any hit; repeated rows and null ids
    pass; other columns, whatever their names, are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under the threshold; null and empty
    texts score as texts without any hit. Repeated rows, null ids and columns of any
    name pass; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(batches, docs.schema)


def is_training(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 5) != 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), is_training()))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
