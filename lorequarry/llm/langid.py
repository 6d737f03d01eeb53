"""Language identification by hierarchical discrimination.

A first set of linear classifiers, one for each language family against the rest, picks the family. Within it, linear
support vector machines for every pair of its languages vote. All work on relative frequencies of character n-grams of
the whole text, so that a score is a mean of table values over the text's n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import Grams, chunks, has_letter, pieces
from .workspace import bound_batches, lean, plain_names

LENGTHS = (2, 3, 4)
BITS = 18
#: The classifiers are fitted on at most about this many documents, shared evenly by the languages; each has one at least.
SAMPLE_DOCS = 1200
UNKNOWN = "und"
#: n-grams of this length tell which share of a text looks like the training texts.
KNOWN_LENGTH = 3
#: Below this score the pipeline rejects a document.
REJECT_BELOW = 0.5

# Language families by ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru pl cs sk uk be bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si or as",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv su mg mi haw",
    "sinitic": "zh yue wuu",
    "tai": "th lo",
    "bantu": "sw zu xh sn rw st",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold_: int) -> Column:
    """Whether the row is in the fold that nothing is learned from. A row without an id is in no fold: it isn't held out,
    and nothing is learned from it either."""
    return F.coalesce(fold(doc_id, folds) == fold_, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    #: (family, language, language) of each pairwise classifier
    pairs: list[tuple[str, str, str]]
    #: one row for each family, then for each pair, of the weights of the known n-grams and a 0 for all others
    tables: np.ndarray
    bias: np.ndarray
    #: the column of each n-gram, and which columns are of n-grams of the training texts
    column: np.ndarray
    known: np.ndarray


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and relative frequencies of each text; n-gram lengths weigh alike."""
    for a, b in chunks(texts):
        g = Grams(texts[a:b], max(LENGTHS))
        real = g.real()
        codes = [np.where(real, g.hashed(n, BITS), -1) for n in LENGTHS]
        for i, j in zip(g.starts, g.offsets[1:], strict=True):
            idx, cnt = np.unique(np.concatenate([c[i:j] for c in codes]), return_counts=True)
            idx, cnt = (idx[1:], cnt[1:]) if len(idx) and idx[0] < 0 else (idx, cnt)
            yield idx.astype(np.int32), (cnt / max(1, cnt.sum())).astype(np.float32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 128):
            texts = [t or "" for t in part.column("text").to_pylist()]
            idx, val = zip(*features(texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "h", "idx", "val"])


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 10.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear support vector machine with hinge loss, by dual coordinate descent; rows are sparse."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    share = {s: max(1, (y == s).sum()) for s in (-1, 1)}
    bound = np.array([c * len(rows) / (2 * share[int(s)]) for s in y])
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; rows whose text or lang is null teach nothing.

    The sample is bounded: of each language those documents whose id hashes lowest, about ``sample_docs`` in all, and at
    least one of each. The driver holds their sparse features only.
    """
    bound_batches(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null")
    h = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    found = docs.groupBy("lang").agg(F.count("*").alias("n"), F.min(h).alias("low")).collect()  # a row a language
    counts = {r["lang"]: r["n"] for r in found}
    languages = sorted(counts)
    if not languages:
        return Model([], [], [], np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(1 << BITS, np.int32), np.zeros(1, bool))
    cap = max(1, sample_docs // len(languages))
    # the document that hashes lowest, and all up to the language's share
    low = {r["lang"]: r["low"] for r in found}
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(low[k], min(1.0, cap / n))))])
    sample = docs.select("lang", "text", h.alias("h")).where(F.col("h") <= F.element_at(rate, F.col("lang")))
    got = sample.mapInArrow(lean(_extract), "lang string, h double, idx array<int>, val array<float>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    langs = got["lang"].to_pylist()
    lists, weights = got["idx"].combine_chunks(), got["val"].combine_chunks()
    idx, val = lists.flatten().to_numpy(), weights.flatten().to_numpy()
    seen = np.unique(idx)
    column = np.full(1 << BITS, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    mean = np.bincount(idx, weights=val, minlength=1 << BITS) / max(1, len(langs))
    # frequent n-grams vary more; this brings all to one scale
    scale = 1 / np.sqrt(mean + 1e-5)
    val = (val * scale[idx]).astype(np.float32)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    rows = [(idx[i:j], val[i:j]) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)] if len(ends) else []
    del lists, weights, got
    of = np.array([family_of(x) for x in langs]) if langs else np.array([], str)
    langs = np.array(langs)
    families = sorted({family_of(x) for x in languages})
    learn = lambda r, y: (lambda w, b: (w[seen], b))(*svm(r, y, 1 << BITS))
    fitted, pairs = [], []
    for f in families if len(families) > 1 else []:
        fitted.append(learn(rows, np.where(of == f, 1, -1)))
    for f in families:
        for a, b in combinations([x for x in languages if family_of(x) == f], 2):
            at = np.flatnonzero((langs == a) | (langs == b))
            pairs.append((f, a, b))
            fitted.append(learn([rows[i] for i in at], np.where(langs[at] == a, 1, -1)))
    tables = np.zeros((len(fitted), len(seen) + 1), np.float32)
    for k, (w, _) in enumerate(fitted):
        tables[k, :-1] = w * scale[seen]
    del rows, idx, val
    pa.default_memory_pool().release_unused()
    return Model(languages, families, pairs, tables, np.array([b for _, b in fitted]), column, np.arange(len(seen) + 1) < len(seen))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the product of the confidence in the family, of that in the language
    against its closest rival, and of the share of the text's n-grams that occur in the training texts."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    bodies = [t or "" for t in texts]
    if not model.languages:
        return lang, score
    sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
    members = defaultdict(list)
    for k, (f, a, b) in enumerate(model.pairs):
        members[f].append((len(model.tables) - len(model.pairs) + k, a, b))
    for first, last in chunks(bodies):
        g = Grams(bodies[first:last], max(LENGTHS))
        real = g.real()
        n = np.add.reduceat(real.astype(np.int64), g.starts)
        margin = np.zeros((len(model.tables), last - first))
        for length in LENGTHS:
            idx = model.column.take(g.hashed(length, BITS))
            for k, table in enumerate(model.tables):
                margin[k] += np.add.reduceat(np.where(real, table.take(idx), np.float32(0)), g.starts, dtype=np.float64)
            if length == KNOWN_LENGTH:
                share = np.add.reduceat((real & model.known.take(idx)).astype(np.int64), g.starts) / np.maximum(1, n)
        margin = margin / np.maximum(1, n * len(LENGTHS)) + model.bias[:, None]
        for i in range(last - first):
            if not has_letter(texts[first + i]):
                continue
            family, p = model.families[0], 1.0
            if len(model.families) > 1:
                m = margin[: len(model.families), i]
                top = int(np.argmax(m))
                family, p = model.families[top], float(sure((m[top] - np.delete(m, top).max()) / 2))
            inside = members.get(family)
            if inside:
                votes, least = defaultdict(int), defaultdict(lambda: np.inf)
                for k, a, b in inside:
                    m = margin[k, i]
                    votes[a if m >= 0 else b] += 1
                    least[a], least[b] = min(least[a], m), min(least[b], -m)
                best = max(least, key=lambda x: (votes[x], least[x], x))
                p *= float(sure(least[best]))
            else:
                best = next(x for x in model.languages if family_of(x) == family)
            lang[first + i], score[first + i] = best, p * share[i]
    return lang, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, lang_pred, score``, a row per input row; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language was learned. Repeated
    rows get equal results. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                lang, score = classify(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told with a score of at least ``reject_below``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                lang, score = classify(model, part.column("text").to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= reject_below for x, s in zip(lang, score, strict=True)], pa.bool_()))

    plain = plain_names(docs, "text")
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


HELD_OUT, FOLDS = 2, 4


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: in a fold, and not in the one held out."""
    return docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
