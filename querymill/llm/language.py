"""Language of words in mixed text by a linear-chain conditional random field.

A word is a run of letters. Its features are hashed into one table of weights: letter pairs and triples with
word borders, affixes of three letters, and the word itself as lexicon entry. Transitions between the languages of
neighbouring words are learned with them. Forward-backward runs over all words of many documents at once: a
row of words becomes a product of small matrices, so long documents cost no more per word than short
ones. The language of a document is that with the greatest posterior share of its letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.text import broadcast_if_small, staged, words

#: Bounds of the training sample: documents of each language, and neighbouring words of each document.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 120
TABLE, STEPS, RATE, DECAY = 2**17, 30, 0.4, 1e-4
#: Words between two switches of language in the mixed training text, least and most.
SWITCH = (4, 40)
WIDTH = 64
CHARS = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Model:
    """Languages, feature weights (table x languages), log transitions (from x to) and log start."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C
    return ((x ^ (x >> np.uint64(32))) & np.uint64(TABLE - 1)).astype(np.int64)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _A)]))


@dataclass
class Words:
    """Words of many texts: features of letters (two a letter) and of words (three a word), borders, owners."""

    by_letter: np.ndarray
    by_word: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def read(texts: list[str]) -> Words:
    """The words of texts, in order. owner: number of the text; first: the word begins its text."""
    lower = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp] if len(cp) else np.zeros(0, bool)
    kept = np.where(is_letter, cp, 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(3, np.uint64), kept, np.zeros(3, np.uint64)])
    at = np.flatnonzero(is_letter)
    before, here, after = padded[at + 2], padded[at + 3], padded[at + 4]
    pair = _bucket(here * _A + after * _B + np.uint64(1))
    triple = _bucket(before * _C + here * _A + after * _B + np.uint64(2))
    begin = here.size and (before == 0)
    starts = np.flatnonzero(begin) if here.size else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(at)]])).astype(np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64), none, none, none, np.zeros(0, bool))
    s, e = at[starts] + 3, at[starts + sizes - 1] + 3
    # letters after a border are zero, so short words have affixes of their own
    after_1 = padded[s + 1]
    after_2 = np.where(after_1 == 0, np.uint64(0), padded[s + 2])
    before_1 = padded[e - 1]
    before_2 = np.where(before_1 == 0, np.uint64(0), padded[e - 2])
    head = _bucket(padded[s] * _A + after_1 * _B + after_2 * _C + np.uint64(3))
    tail = _bucket(padded[e] * _A + before_1 * _B + before_2 * _C + np.uint64(4))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    whole = _bucket(np.add.reduceat(here * _powers()[place % 4096], starts) + np.uint64(5))
    ends = np.cumsum([len(t) + 1 for t in lower])
    owner = np.searchsorted(ends, at[starts], side="right")
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    return Words(np.stack([pair, triple], 1), np.stack([head, tail, whole], 1), starts, sizes, owner, first)


def scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features, words x languages."""
    by_letter = weights[w.by_letter[:, 0]] + weights[w.by_letter[:, 1]]
    return np.add.reduceat(by_letter, w.starts, axis=0) + weights[w.by_word].sum(axis=1)


def posteriors(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior languages of each word, and expected moves (from x to) between words of a text.

    The words are dealt into rows of WIDTH. The product of the matrices of each row is built for all rows at once, rows are
    tied by one vector each, then vectors run through all rows at once, forward and backward.
    """
    n, k = emit.shape
    rows = -(-n // WIDTH)
    e = np.ones((rows * WIDTH, k))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = np.maximum(e, 1e-30).reshape(rows, WIDTH, k)
    new = np.ones(rows * WIDTH, bool)
    new[:n] = first
    new = new.reshape(rows, WIDTH)
    t, p = np.exp(moves), np.exp(start)

    def forth(v: np.ndarray, c: int) -> np.ndarray:
        """v (rows, ..., k) through word c of each row."""
        moved = v @ t
        reset = v.sum(axis=-1, keepdims=True) * p
        at = new[:, c].reshape(-1, *[1] * (v.ndim - 1))
        out = np.where(at, reset, moved) * e[:, c].reshape(rows, *[1] * (v.ndim - 2), k)
        return out / np.maximum(out.max(axis=tuple(range(1, v.ndim)), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(k), (rows, k, k))
    for c in range(WIDTH):
        product = forth(product, c)
    into = np.empty((rows, k))
    v = p / p.sum()
    for r in range(rows):
        into[r] = v
        v = v @ product[r]
        v = v / v.sum()
    ahead = np.empty((rows, WIDTH, k))
    v = into
    for c in range(WIDTH):
        v = forth(v, c)
        ahead[:, c] = v
    out_of = np.empty((rows, k))
    v = np.ones(k)
    for r in range(rows - 1, -1, -1):
        out_of[r] = v
        v = product[r] @ v
        v = v / v.sum()
    behind = np.empty((rows, WIDTH, k))
    v = out_of
    for c in range(WIDTH - 1, -1, -1):
        behind[:, c] = v
        onward = e[:, c] * v
        v = np.where(new[:, c, None], (onward * p).sum(axis=1, keepdims=True), onward @ t.T)
        v = v / np.maximum(v.max(axis=1, keepdims=True), 1e-300)
    post = (ahead * behind).reshape(-1, k)[:n]
    post = post / post.sum(axis=1, keepdims=True)
    ahead, onward = ahead.reshape(-1, k)[:n], (e * behind).reshape(-1, k)[:n]
    inner = np.flatnonzero(~first)
    each = ahead[inner - 1][:, :, None] * t[None] * onward[inner][:, None, :]
    return post, (each / each.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def mixed(samples: list[tuple[str, int]], seed: int = 11) -> tuple[list[str], list[list[int]]]:
    """Code-switched training texts out of samples (text, language), with the language of each of their pieces of words."""
    rng = np.random.default_rng(seed)
    pieces = []
    for text, lang in samples:
        w, at = text.split(), 0
        while at < len(w):
            step = int(rng.integers(*SWITCH))
            pieces.append((w[at : at + step], lang))
            at += step
    order = rng.permutation(len(pieces))
    texts, langs, at = [], [], 0
    while at < len(pieces):
        step = int(rng.integers(1, 6))
        chosen = [pieces[i] for i in order[at : at + step]]
        texts.append(" ".join(" ".join(w) for w, _ in chosen))
        langs.append([lang for w, lang in chosen for x in w for _ in range(_runs(x))])
        at += step
    return texts, langs


def _runs(word: str) -> int:
    mask = [c.isalpha() for c in word.lower()]
    return sum(b and not a for a, b in zip([False, *mask], mask))


def fit(samples: list[tuple[str, str]]) -> Model | None:
    """Maximum likelihood with a little decay, by adaptive gradient steps over all samples."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    k = len(langs)
    texts, labels = mixed([(t, langs.index(lang)) for t, lang in sorted(samples)])
    w, y = read(texts), np.concatenate([np.array(x, np.int64) for x in labels])
    model = Model(langs, np.zeros((TABLE, k), np.float32), np.full((k, k), -np.log(k)), np.full(k, -np.log(k)))
    if not len(w.starts):
        return model
    truth = np.eye(k)[y]
    inner = np.flatnonzero(~w.first)
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (y[inner - 1], y[inner]), 1)
    seen_start = truth[w.first].sum(axis=0)
    model.start = np.log((seen_start + 1) / (seen_start.sum() + k))
    rate_w, rate_m = np.full((TABLE, k), 1e-8), np.full((k, k), 1e-8)
    owner = np.repeat(np.arange(len(w.starts)), w.sizes)
    for _ in range(STEPS):
        post, expected = posteriors(scores(w, model.weights).astype(np.float64), w.first, model.moves, model.start)
        error = (truth - post) / len(y)
        grad = np.empty((TABLE, k))
        for j in range(k):
            by_letter = error[owner, j]
            grad[:, j] = sum(np.bincount(w.by_letter[:, f], by_letter, TABLE) for f in range(2)) + sum(np.bincount(w.by_word[:, f], error[:, j], TABLE) for f in range(3))
        grad -= DECAY * model.weights / TABLE
        rate_w += grad**2
        model.weights += (RATE * grad / np.sqrt(rate_w)).astype(np.float32)
        grad_m = (seen_moves - expected) / len(y)
        rate_m += grad_m**2
        model.moves = model.moves + RATE * grad_m / np.sqrt(rate_m)
        model.moves -= np.log(np.exp(model.moves).sum(axis=1, keepdims=True))
    return model


def label(texts: list[str], model: Model) -> tuple[np.ndarray, Words]:
    """Posterior languages of all words of texts, and the words."""
    w = read(texts)
    if not len(w.starts):
        return np.zeros((0, len(model.langs))), w
    return posteriors(scores(w, model.weights).astype(np.float64), w.first, model.moves, model.start)[0], w


def labeller(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score)."""

    def predicted(texts: list[str]) -> tuple[list[str], list[float]]:
        if model is None:
            return ["und"] * len(texts), [0.0] * len(texts)
        post, w = label(texts, model)
        share = np.stack([np.bincount(w.owner, w.sizes * post[:, j], len(texts)) for j in range(len(model.langs))], 1)
        size = share.sum(axis=1)
        best = share.argmax(axis=1)
        names = [model.langs[b] if s > 0 else "und" for b, s in zip(best, size)]
        return names, np.clip(share.max(axis=1) / np.maximum(size, 1e-300), 0, 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure, group, held = [], [], [], 0
            for cell in batch.column(2):
                group.append(cell.as_py() or "")
                held += len(group[-1])
                if held >= CHARS:
                    a, b = predicted(group)
                    names, sure, group, held = names + a, sure + b, [], 0
            if group:
                a, b = predicted(group)
                names, sure = names + a, sure + b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, n_words: int = SAMPLE_WORDS) -> DataFrame:
    """(text, lang): at most per_lang documents of each language, the first by a hash, and n_words neighbouring words of each.

    A draw by the hash first thins every language to about five times that many, so that ranking works on
    a bounded number of rows however large a language is.
    """
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    # one row a language
    sizes = broadcast_if_small(staged(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages"))
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(2**31)) / F.lit(float(2**31))
    thinned = rows.join(sizes, "lang").filter(share * F.col("n") < 5 * per_lang).filter(F.col("text").rlike(r"\p{L}"))
    drawn = thinned.select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_lang)
    each = ranked.select("lang", "h", words(F.col("text")).alias("w"))
    begin = F.pmod(F.col("h"), F.greatest(F.size("w") - n_words, F.lit(0)) + 1).cast("int") + 1
    return each.select(F.array_join(F.slice("w", begin, n_words), " ").alias("text"), "lang")


def train(docs: DataFrame) -> Model | None:
    """Fit on a sample of bounded size: SAMPLE_DOCS x SAMPLE_WORDS words a language, held-out documents excluded."""
    return fit([(r["text"], r["lang"]) for r in training_sample(docs).collect()])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text).

    Null texts and texts without letters are ``und`` with score 0, and so is all without a model. Equal shares go to the
    first language by name. The model has a fixed number of weights.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(labeller(model), "doc_id long, held_out boolean, lang_pred string, score double")
