"""Language identification by interpolated Kneser-Ney character 4-gram models."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import drop_written, id_remainder, table, written

#: Characters that are counted or scored at once.
CHUNK_CHARS = 1 << 20
#: More 4-gram types than this (all languages), or cells of types x languages, and the
#: driver refuses the model: 256 MB of log-probabilities at most.
MAX_TYPES, MAX_CELLS = 8_000_000, 1 << 26
#: A language with fewer training rows than this takes the limit of all together.
LEAST_ROWS = 20
#: Steps a bit in which the training rows' bits are counted for the limits.
STEPS = 1000
#: A text is rejected DEVIATIONS deviations above its language's median, a bit at least.
#: SHORT is what the square root of a text's length allows: short texts vary more.
DEVIATIONS, LEAST_BITS, SHORT = 10.0, 1.0, 12.0
SPACE = np.uint16(32)
#: Letters of a text that count in the confidence.
EVIDENCE = 200
#: Each bit a character above the limit halves the confidence so many times.
FADE = 8.0


@functools.cache
def letter_codes() -> np.ndarray:
    """Code of each character of the basic plane: its lower case, or a space for what is no letter."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
    return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts with runs of other characters as one space, and
    the number of the text of each code."""
    lens = np.array([len(t) + 1 for t in texts])
    cps = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if (high := cps >= 1 << 16).any():  # other planes' letters share the codes of the private area
        cps = cps.copy()
        odd, back = np.unique(cps[high], return_inverse=True)
        cps[high] = np.array([0xE000 + int(c) % 0x1900 if chr(c).isalpha() else 32 for c in odd])[back]
        codes = letter_codes()[cps]
        codes[high] = cps[high]
    else:
        codes = letter_codes()[cps]
    space = codes == SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return codes[keep], np.repeat(np.arange(len(texts), dtype=np.int32), lens)[keep]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (three characters of context, spaces before a text's start,
    and the character itself) and the number of the text of each."""
    codes, doc = codes_of(texts)
    gram = codes.astype(np.uint64)
    before = codes
    for back in (1, 2, 3):
        c = np.full(len(codes), SPACE, np.uint64)
        c[back:] = np.where(doc[back:] == doc[:-back], codes[:-back], SPACE)
        if back == 1:
            before = c
        gram |= c << np.uint64(16 * back)
    valid = ~((codes == SPACE) & (before == SPACE))
    return gram[valid], doc[valid]


def in_chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    a = total = 0
    for b, t in enumerate(texts):
        if total and total + len(t) > most:
            yield a, b
            a, total = b, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    out, back = np.unique(k, return_inverse=True)
    return out, np.bincount(back, n, len(out)).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each 4-gram occurs in the texts of each language.

    Tasks add up their own rows first, so that a row for each type, not for each
    character, is shuffled; a hot language is spread over all tasks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in it:
            by: dict[str, list[str]] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                got = held.setdefault(lang, [])
                for a, b in in_chunks(texts):
                    got.append(np.unique(grams_of(texts[a:b])[0], return_counts=True))
                if len(got) > 16:
                    held[lang] = [summed(*map(list, zip(*got, strict=True)))]
        for lang, got in held.items():
            keys, counts = summed(*map(list, zip(*got, strict=True)))
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(counts[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(text_col, lang_col).mapInArrow(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys in a sorted array, 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class Order:
    """One order of one language's model: sorted arrays of hashed n-grams and contexts."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    discount: float

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Order:
        """The discount is n1 / (n1 + 2 n2) of the n-grams counted once and twice, from 0.1 to 0.9."""
        contexts, at = np.unique(grams >> np.uint64(16), return_inverse=True)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        return cls(grams, counts.astype(float), contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float), discount)


@dataclass
class KneserNey:
    """Orders 4, 3, 2 and 1: raw counts at the top, continuation counts (kinds of
    characters seen before an n-gram) below; absolute discounting, interpolated."""

    orders: list[Order]
    floor: float

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
        orders = [Order.of(grams, counts)]
        for n in (3, 2, 1):
            below, kinds = np.unique(orders[-1].grams & np.uint64((1 << 16 * n) - 1), return_counts=True)
            orders.append(Order.of(below, kinds))
        return cls(orders, 1 / (alphabet + 1))

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor)
        for n, order in zip((1, 2, 3, 4), reversed(self.orders), strict=True):
            key = grams & np.uint64((1 << 16 * n) - 1)
            context = key >> np.uint64(16)
            total = find(order.contexts, order.totals, context)
            seen = np.maximum(find(order.grams, order.counts, key) - order.discount, 0)
            share = np.where(total > 0, order.discount * find(order.contexts, order.types, context) / np.maximum(total, 1), 1)
            p = np.where(total > 0, seen / np.maximum(total, 1), 0) + share * p
        return p


@dataclass
class LanguageModel:
    """Models of all languages, with the log-probabilities of every 4-gram seen in any of them."""

    langs: list[str]
    models: list[KneserNey]
    grams: np.ndarray
    bits: np.ndarray  # -log2 p, a row for each gram and a column for each language
    #: Most bits a character of each language beyond what a text's length allows; '' for the rest.
    limits: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        langs = sorted(counts)
        every = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.empty(0, np.uint64)
        alphabet = len(np.unique(every & np.uint64(0xFFFF)))
        models = [KneserNey.of(*counts[x], alphabet) for x in langs]
        bits = np.stack([-np.log2(m.probability(every)) for m in models], 1).astype(np.float32) if langs else np.empty((0, 0), np.float32)
        return cls(langs, models, every, bits)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character in each language (texts x languages), and the number of characters."""
        n = len(texts)
        gram, doc = grams_of(texts)
        total = np.zeros((n, len(self.langs)))
        size = np.bincount(doc, minlength=n)
        if len(gram) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            new = self.grams[at] != gram
            bits = self.bits[at]
            if new.any():
                bits[new] = np.stack([-np.log2(m.probability(gram[new])) for m in self.models], 1)
            some = size > 0
            total[some] = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0, dtype=np.float64)
        return total / np.maximum(size, 1)[:, None], size

    def own_bits(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of training texts in the language that each has, and the
        number of characters. All their 4-grams have been counted."""
        gram, doc = grams_of(texts)
        size = np.bincount(doc, minlength=len(texts))
        column = np.array([self.langs.index(x) if x in self.langs else 0 for x in langs])  # one without characters may be no model's
        bits = self.bits[np.searchsorted(self.grams, gram), column[doc]] if len(gram) else np.empty(0)
        return np.bincount(doc, bits, len(texts)) / np.maximum(size, 1), size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language ('und' without letters), confidence 0 to 1, lowest bits a character, and whether to reject."""
        langs: list[str] = []
        scores, lowest, reject = (np.zeros(len(texts)) for _ in range(3))
        given = [t or "" for t in texts]
        for a, b in in_chunks(given):
            h, size = self.entropies(given[a:b])
            if not self.langs:
                langs += ["und"] * (b - a)
                reject[a:b] = 1
                continue
            best = h.argmin(1)  # ties: the first language by name
            low = h[np.arange(b - a), best]
            gap = (h - low[:, None]) * np.minimum(size, EVIDENCE)[:, None] * np.log(2) / 4
            names = [self.langs[i] if m else "und" for i, m in zip(best.tolist(), size.tolist(), strict=True)]
            langs += names
            over = self.excess(names, low, size)
            scores[a:b] = np.where(size > 0, np.exp2(-np.maximum(over, 0) * FADE) / np.exp(-gap).sum(1), 0)
            lowest[a:b] = np.where(size > 0, low, 0)
            reject[a:b] = (over > 0) | (size == 0)
        return langs, scores, lowest, reject.astype(bool)

    def excess(self, langs: list[str], bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits a character above the limit of the language; such texts are rejected."""
        most = np.array([self.limits.get(x, self.limits.get("", np.inf)) for x in langs])
        return bits - SHORT / np.sqrt(np.maximum(size, 1)) - most


def train(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count all training texts and build the models.

    Counts cover every training row. What comes to the driver is one row for each
    4-gram type, refused above MAX_TYPES or MAX_CELLS. The rejection limits are fitted on
    every training row with letters: the median of the bits a character beyond what a
    text's length allows, and DEVIATIONS times the deviation that the median absolute
    deviation stands for, LEAST_BITS at least. So a few garbled rows do not lift a limit,
    and short texts count. Bits are rounded to one in STEPS and counted, so a row comes to
    the driver for each value that occurs in a language, however many texts have it.

    Defined cases: null texts and languages teach nothing; repeated rows count each time;
    null ids are an id; without any training row there is no language; other columns,
    whatever their names, are ignored."""
    chosen = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = written(gram_counts(chosen), "grams")
    n_langs = chosen.select("lang").distinct().count()
    types = counted.count()
    if types > MAX_TYPES or types * n_langs > MAX_CELLS:
        raise ValueError(f"more than {MAX_TYPES} 4-gram types or {MAX_CELLS} of types x languages: no language model of bounded size")
    rows = counted.toArrow()
    drop_written(counted)
    lang, gram, n = rows["lang"].to_pandas().to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(gram, kind="stable")
    lang, gram, n = lang[order], gram[order], n[order]
    model = LanguageModel.of({x: (gram[lang == x], n[lang == x]) for x in dict.fromkeys(lang.tolist())})
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def steps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, langs = (c.to_pylist() for c in batch.columns)
            found = [shared.value.own_bits(texts[a:b], langs[a:b]) for a, b in in_chunks(texts)]
            bits, size = (np.concatenate([x[k] for x in found]) if found else np.empty(0) for k in (0, 1))
            own = np.rint((bits - SHORT / np.sqrt(np.maximum(size, 1))) * STEPS).astype(np.int64)
            some = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(own)], names=["lang", "step"]).filter(some)

    measured = chosen.select("text", "lang").mapInArrow(steps, "lang string, step long").groupBy("lang", "step").agg(F.count("*").alias("n")).toArrow()
    lang, step, n = measured["lang"].to_pandas().to_numpy(), measured["step"].to_numpy(), measured["n"].to_numpy()
    by = {x: limit(step[lang == x] / STEPS, n[lang == x]) for x in dict.fromkeys(lang.tolist()) if n[lang == x].sum() >= LEAST_ROWS}
    model.limits = by | ({"": limit(step / STEPS, n)} if len(n) else {})
    return model


def median(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that occur so often each."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    low, high = (values[order][np.searchsorted(upto, k, "right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return float(low + high) / 2


def limit(bits: np.ndarray, counts: np.ndarray) -> float:
    """The most that passes: median and deviation stand against a few garbled rows."""
    middle = median(bits, counts)
    spread = 1.4826 * median(np.abs(bits - middle), counts)
    return round(middle + max(DEVIATIONS * spread, LEAST_BITS), 6)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, bits, rejected) of every row.

    Narrow: one Arrow batch at a time against the broadcast model. Defined cases:
    null, empty and letterless texts are 'und' with score 0 and rejected; repeated
    rows and null ids pass; without any learned language all rows are 'und'; other
    columns, whatever their names, are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs, scores, bits, reject = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(bits), pa.array(reject)], names=[id_col, "lang_pred", "score", "bits", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language the model does not reject: null,
    empty and letterless texts go, and texts too far from every language. Repeated rows,
    null ids and columns of any name pass; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(~shared.value.predict(batch.column(at).to_pylist())[3]))

    return docs.mapInArrow(batches, docs.schema)


def is_training(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 3) != 1


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs, is_training()))
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected", F.round("bits", 4).alias("bits"))
