"""Operator 1: language identification by a linear-chain conditional random field.

Words carry affix, character n-gram and lexicon features; transitions between the labels of neighbouring words are
learned. Forward-backward labels each word of a text, also where it switches language within; a document's language is
the one that holds most of its letters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, table

#: A word is up to WIDTH letters; longer runs of letters are several words.
WIDTH = 24
WORD = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")
#: Word characters that are no letters: numbers that aren't decimal digits, such as fractions and Roman numerals.
NUMBERS = {i: " " for i in range(0x110000) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal()}
#: Feature numbers; with many languages fewer, so that the weights stay below CELLS.
BUCKETS, CELLS = 1 << 17, 1 << 26
#: At most about this many labelled documents of each language and in all are learned from, of each at most so many
#: passages of so many words, drawn evenly over the whole text; a word must occur this often in them to enter the lexicon.
DOCS_PER_LANG, DOCS, PASSAGES, PASSAGE, LEXICON_COUNT = 400, 20_000, 32, 96, 4
SEED, STEPS, RATE, SEQUENCES, LENGTH = 11, 240, 0.25, 32, 128
BLOCK = 32
#: Labels from which texts go a word at a time.
MANY = 48
UNDETERMINED = "und"
#: Words whose scores a worker remembers.
CACHE = 200_000
#: Characters worked on at once in a worker.
SLICE = 500_000


def words_of(text: str) -> list[str]:
    words = WORD.findall(text)
    return words if not words or "".join(words).isalpha() else WORD.findall(text.translate(NUMBERS))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (buckets + 1 + len(lexicon), labels); row 0 stays 0
    trans: np.ndarray  # log potentials, from x to
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)
    buckets: int = BUCKETS


def features(words: list[str], lexicon: dict[str, int], width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Feature numbers, a row a word; 0 stands for no feature."""
    n = len(words)
    code = np.zeros((n, width + 2), np.uint64)
    code[:, 0] = 1
    if n:
        code[:, 1:-1] = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(n, width)
    size = np.fromiter(map(len, words), np.int64, n)
    code[np.arange(n), size + 1] = 2
    mix, cols = np.uint64(0x9E3779B97F4A7C15), []

    def put(kind: int, parts: list[np.ndarray], holds: np.ndarray) -> None:
        h = np.full(n, kind, np.uint64)
        for p in parts:
            h = (h ^ p) * mix
            h ^= h >> np.uint64(29)
        cols.append(np.where(holds, (h % np.uint64(buckets - 1)).astype(np.int32) + 1, 0))

    for k in (2, 3):
        for i in range(width + 3 - k):
            put(k, [code[:, i + j] for j in range(k)], size + 2 >= i + k)
    rows = np.arange(n)
    for k in (1, 2, 3):
        put(10 + k, [code[:, 1 + j] for j in range(k)], size >= k)
        put(20 + k, [code[rows, np.maximum(size - k + 1 + j, 0)] for j in range(k)], size >= k)
    cols.append(np.fromiter((lexicon.get(w, -buckets) for w in words), np.int32, n) + buckets)
    return np.stack(cols, axis=1) if n else np.zeros((0, len(cols)), np.int32)


def emissions(model: Crf, words: list[str]) -> np.ndarray:
    """Scores (words, labels); words of like length are scored together."""
    out = np.zeros((len(words), len(model.labels)))
    size = np.fromiter(map(len, words), np.int64, len(words))
    for low, high in ((0, 6), (6, 12), (12, WIDTH)):
        for at in np.array_split(np.flatnonzero((size > low) & (size <= high)), max(1, len(words) // 20_000)):
            if len(at):
                out[at] = model.weights[features([words[i] for i in at], model.lexicon, high, model.buckets)].sum(axis=1)
    return out


def posteriors(score: np.ndarray, offsets: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward over many texts at once. ``offsets`` bounds the texts.

    Texts are cut into blocks; a block's effect is a matrix product, so that blocks of all texts advance together and a
    text of any length is exact. With many labels, whose matrices are large, each text goes a word at a time."""
    k, count = score.shape[1], np.diff(offsets)
    if k > MANY:
        return _by_word(score, offsets, trans, start)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    blocks = -(-count // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    owner = np.repeat(np.arange(len(count)), blocks)
    nth = np.arange(nb) - first[owner]
    begin = offsets[owner] + nth * BLOCK
    here = begin[:, None] + np.arange(BLOCK)
    live = here < offsets[owner + 1][:, None]
    e = p[np.where(live, here, 0)]
    e[~live] = 1.0
    head = nth == 0
    eye = np.eye(k)
    m = np.repeat(eye[None], nb, axis=0)
    for t in range(BLOCK):
        step = (m.reshape(-1, k) @ a).reshape(nb, k, k)
        if t == 0:
            step[head] = eye
        step *= e[:, t, None, :]
        m = np.where(live[:, t, None, None], step, m) if t else step
        if t % 8 == 7:
            m /= m.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((nb, k)), np.empty((nb, k))
    order = np.argsort(-blocks, kind="stable")
    sizes = -blocks[order]
    run = np.repeat(s[None], len(order), axis=0)
    for j in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(sizes, -j, side="left"))
        at = first[order[:n]] + j
        ahead[at] = run[:n]
        run = np.einsum("nk,nkl->nl", run[:n], m[at])
        run /= run.max(axis=1, keepdims=True)
    run = np.ones((len(order), k))
    for j in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(sizes, -j, side="left"))
        at = first[order[:n] + 1] - 1 - j
        behind[at] = run[:n]
        run = np.einsum("nkl,nl->nk", m[at], run[:n])
        run /= run.max(axis=1, keepdims=True)
    fore = np.empty((BLOCK, nb, k))
    run = ahead
    for t in range(BLOCK):
        step = run @ a
        if t == 0:
            step[head] = run[head]
        step *= e[:, t]
        step /= step.max(axis=1, keepdims=True)
        run = np.where(live[:, t, None], step, run)
        fore[t] = run
    run = behind
    for t in range(BLOCK - 1, -1, -1):
        fore[t] *= run
        step = (e[:, t] * run) @ a.T
        step /= step.max(axis=1, keepdims=True)
        run = np.where(live[:, t, None], step, run)
    got = fore.transpose(1, 0, 2)[live]
    return got / got.sum(axis=1, keepdims=True)


def _by_word(score: np.ndarray, offsets: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """:func:`posteriors`, one word after the other."""
    p = np.exp(score - score.max(axis=1, keepdims=True))
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    out = np.empty_like(p)
    for low, high in zip(offsets[:-1], offsets[1:]):
        for t in range(low, high):
            out[t] = (s if t == low else out[t - 1] @ a) * p[t]
            out[t] /= out[t].sum()
        back = np.ones(p.shape[1])
        for t in range(high - 1, low - 1, -1):
            out[t] *= back
            out[t] /= out[t].sum()
            back = a @ (p[t] * back)
            back /= back.max()
    return out


def _gradient(p: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of label sequences, (sequences, length); p: scores."""
    n, length, k = p.shape
    e, a = np.exp(p - p.max(axis=2, keepdims=True)), np.exp(trans)
    fore, scale = np.empty_like(e), np.empty((n, length, 1))
    run = np.exp(start) * e[:, 0]
    for t in range(length):
        if t:
            run = (run @ a) * e[:, t]
        scale[:, t] = run.sum(axis=1, keepdims=True)
        run = run / scale[:, t]
        fore[:, t] = run
    back, pairs = np.ones((n, k)), np.zeros((k, k))
    gamma = np.empty_like(e)
    for t in range(length - 1, -1, -1):
        gamma[:, t] = fore[:, t] * back
        gamma[:, t] /= gamma[:, t].sum(axis=1, keepdims=True)
        ahead = e[:, t] * back
        if t:
            whole = ((fore[:, t - 1] @ a) * ahead).sum(axis=1, keepdims=True)
            pairs += a * ((fore[:, t - 1] / whole).T @ ahead)
            back = (ahead @ a.T) / scale[:, t]
    one = np.eye(k)[gold]
    return one - gamma, np.einsum("ntk,ntl->kl", one[:, :-1], one[:, 1:]) - pairs, (one[:, 0] - gamma[:, 0]).sum(axis=0)


def fit(texts: list[str], langs: list[str], seed: int = SEED) -> Crf | None:
    """Learns from labelled texts. Half of the training sequences are pieces of texts of several languages put
    together, so that the transitions learn both to stay and to switch. None if there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    docs = [(words_of(t.lower()), lang) for t, lang in zip(texts, langs)]
    docs = [(w, lang) for w, lang in docs if w]
    labels = sorted({lang for _, lang in docs})
    if not labels:
        return None
    counts = Counter(w for words, _ in docs for w in words)
    lexicon = {w: i + 1 for i, w in enumerate(sorted(w for w, c in counts.items() if c >= LEXICON_COUNT))}
    number = {w: i for i, w in enumerate(counts)}
    k = len(labels)
    buckets = BUCKETS
    while buckets * k > CELLS and buckets > 1 << 12:
        buckets //= 2
    model = Crf(labels, np.zeros((buckets + 1 + len(lexicon), k)), np.zeros((k, k)), np.zeros(k), lexicon, buckets)
    if k == 1:
        return model
    feats = features(list(number), lexicon, buckets=buckets)
    pieces: list[list[tuple[np.ndarray, int]]] = [[] for _ in labels]
    for words, lang in docs:
        ids, at, y = np.array([number[w] for w in words]), 0, labels.index(lang)
        while at < len(ids):
            n = int(rng.integers(8, LENGTH))
            pieces[y].append((ids[at : at + n], y))
            at += n
    squares = [np.full_like(x, 1e-3) for x in (model.weights, model.trans, model.start)]
    for _ in range(STEPS):
        words, gold = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
        for i in range(SEQUENCES):
            y, at = int(rng.integers(k)), 0
            while at < LENGTH:
                ids, _ = pieces[y][int(rng.integers(len(pieces[y])))]
                n = min(len(ids), LENGTH - at)
                words[i, at : at + n], gold[i, at : at + n] = ids[:n], y
                at += n
                if i % 2:
                    y = int(rng.integers(k))
        f = feats[words.ravel()]
        score = model.weights[f].sum(axis=1).reshape(SEQUENCES, LENGTH, k)
        g, gt, gs = _gradient(score, gold, model.trans, model.start)
        g = g.reshape(-1, k)
        used, where = np.unique(f, return_inverse=True)
        where = where.reshape(f.shape)
        total = np.stack([np.bincount(where.ravel(), np.repeat(g[:, j], f.shape[1]), len(used)) for j in range(k)], axis=1)
        total[used == 0] = 0
        squares[0][used] += total**2
        model.weights[used] += RATE * total / np.sqrt(squares[0][used])
        for x, d, sq in ((model.trans, gt, squares[1]), (model.start, gs, squares[2])):
            sq += d**2
            x += RATE * d / np.sqrt(sq)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """A worker's view of a model: remembers word scores between texts."""

    def __init__(self, model: Crf):
        self.model, self.numbers = model, {}
        self.scores = np.zeros((0, len(model.labels)))

    def probabilities(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words of all texts in a row, and the texts' bounds."""
        if len(self.numbers) > CACHE:
            self.numbers, self.scores = {}, self.scores[:0]
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, emissions(self.model, new)])
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        ids = np.fromiter((self.numbers[w] for words in texts for w in words), np.int64, int(offsets[-1]))
        if not len(ids):
            return np.zeros((0, len(self.model.labels))), offsets
        return posteriors(self.scores[ids], offsets, self.model.trans, self.model.start), offsets

    def documents(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """A language and its share of the letters for each text."""
        p, offsets = self.probabilities(texts)
        size = np.fromiter((len(w) for words in texts for w in words), np.float64, len(p))
        sums = np.zeros((len(texts) + 1, p.shape[1]))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            sums[some] = np.add.reduceat(p * size[:, None], offsets[some], axis=0)
        total, best = sums[:-1].sum(axis=1), sums[:-1].argmax(axis=1)
        score = np.where(total > 0, sums[:-1].max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return [self.model.labels[b] if t > 0 else UNDETERMINED for b, t in zip(best, total)], np.minimum(score, 1.0)


def slices(texts: pd.Series, size: int = SLICE) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters; null becomes empty."""
    some, n = [], 0
    for t in texts:
        some.append(t if isinstance(t, str) else "")
        n += len(some[-1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def passages(text: str) -> str:
    """The text's words, lower-cased; of more than PASSAGES * PASSAGE words as many passages from all over the text."""
    words = words_of(text.lower())
    if len(words) > PASSAGES * PASSAGE:
        step = (len(words) - PASSAGE) / (PASSAGES - 1)
        words = [w for i in range(PASSAGES) for w in words[int(i * step) : int(i * step) + PASSAGE]]
    return " ".join(words)


def sampled(df: DataFrame, by: str, key: str, per_value: int, most: int, seed: int) -> DataFrame:
    """(key, by) of about ``per_value`` rows of each value of ``by``, one at least, chosen by a seeded hash of ``key``; with
    over ``most`` values, of some ``most`` of them, by hash, too. Nulls take no part.

    The values' rates are a table of some ``most`` rows that is broadcast, so there may be any number of values, and one of
    them may hold most rows; nothing is collected."""
    million = 1_000_000
    slim = df.select(key, by).filter(F.col(key).isNotNull() & F.col(by).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(million))
    values = slim.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(draw.alias("d"), F.col(key).alias("k"))).alias("_first"))
    many = values.count()
    if many > most:
        values = values.filter(F.pmod(F.xxhash64(F.lit(seed), by), F.lit(million)) < million * most // many)
    rates = values.select(F.col(by).alias("_by"), (F.lit(million) * F.least(F.lit(1.0), F.lit(per_value) / F.col("_n"))).cast("bigint").alias("_rate"), F.col("_first.k").alias("_least"))
    chosen = slim.join(F.broadcast(rates), F.col(by) == F.col("_by")).filter((draw < F.col("_rate")) | (F.col(key) == F.col("_least")))
    return chosen.select(key, by).distinct()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG, most: int = DOCS) -> Crf | None:
    """A model from a bounded sample of the rows that are not held out: some ``most`` documents, PASSAGES passages of each.
    Every language is represented as long as there are no more than ``most``; of more languages as many are, by hash."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = known.agg(F.approx_count_distinct("lang")).first()[0]
    chosen = sampled(known, "lang", "id", max(1, min(per_lang, most // max(1, langs))), most, SEED)

    @F.pandas_udf("string")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(passages)

    picked = known.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # some ``most`` rows
    rows = picked.select("id", drawn("text").alias("text"), "lang").collect()
    rows.sort(key=lambda r: (r.lang, str(r.id), r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """``docs`` with columns lang_pred and score (share of the letters), replacing any of these names.

    Only the text counts. ``und`` and 0 if it is null or has no letter, or there is no model. Rows stay as they are;
    an empty table gives an empty result."""
    base = docs.drop("lang_pred", "score")
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at_once = SLICE // max(1, len(model.labels) // MANY)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = Labeller(shared.value)
        for batch in batches:
            parts = [worker.documents([words_of(t.lower()) for t in some]) for some in slices(batch, at_once)]
            yield pd.DataFrame({"lang": [x for names, _ in parts for x in names], "score": np.concatenate([s for _, s in parts] or [np.zeros(0)])})
        del worker
        give_back()

    marked = base.withColumn("_label", label(F.col(text_col)))
    return marked.select(*base.columns, F.col("_label.lang").alias("lang_pred"), F.col("_label.score").alias("score"))


def label_words(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_spans``: the runs of words of one language, as an array of (start, end, lang) in characters.
    Empty for null texts and texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = Labeller(shared.value)
        for batch in batches:
            out = []
            for some in slices(batch):
                found = [[(m.start(), m.end(), m[0].lower()[:WIDTH] or m[0]) for m in WORD.finditer(t if t.isascii() else t.translate(NUMBERS))] for t in some]
                p, offsets = worker.probabilities([[w for _, _, w in f] for f in found])
                best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
                for f, a, b in zip(found, offsets[:-1], offsets[1:]):
                    runs: list[dict] = []
                    for (i, j, _), y in zip(f, best[a:b]):
                        name = worker.model.labels[y]
                        if runs and runs[-1]["lang"] == name:
                            runs[-1]["end"] = j
                        else:
                            runs.append({"start": i, "end": j, "lang": name})
                    out.append(runs)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("lang_spans", label(F.col(text_col)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`identify` of ``documents``: doc_id, held_out, lang_pred, score. Null texts and texts without letters are ``und``."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
