"""Operator 11: secrets by patterns and by character Markov models.

Base spans come from one pattern a kind. Two second-order character models, of random strings and of ordinary identifiers,
are counted over all documents: what the patterns mark is labelled random, all else ordinary; each is mixed with a model of
generated labelled samples, so that shapes that a corpus lacks are not unknown. A run of token characters outside the base
spans is a secret if its log-likelihood ratio says so."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .language_id import slices

KINDS = ("assign", "access", "hex")
RANDOM = "random"
ALL_KINDS = (*KINDS, RANDOM)
#: The contract's patterns. A match that is too short is dropped; runs are matched whole, so no retry could find another.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: What the models may judge: a run of token characters with a letter and a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
K = len(ALPHABET) + 1  # 0 stands for all else
CODES = np.zeros(128, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(1, K)
#: A secret needs this log-likelihood ratio in all (a prior of one in a million) and for each character, and this many
#: different characters: a repeated letter is as unlikely in either model.
TOTAL, EACH, DIFFERENT = float(np.log(1e6)), 0.5, 8
#: The share of the corpus in each mixed model, and the weight of the next shorter context.
SHARE, BACK = 0.6, 4.0
SEED, SAMPLES = 5, 4000
#: Words that generated identifiers are made of.
WORDS = "get set user name file path data list item count index page node size type code date time version build config server client request response handler value table column image model test main service manager default order report release".split()
SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's spans, (start, end, kind) by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def codes(text: str) -> np.ndarray:
    """A code a character, after two that stand for the start."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(2, np.int64), np.where(points < 128, CODES[np.minimum(points, 127)], 0)])


def triples(code: np.ndarray) -> np.ndarray:
    """The number of each character with the two before it."""
    return (code[:-2] * K + code[1:-1]) * K + code[2:]


def ordinary_samples(n: int = SAMPLES, seed: int = SEED) -> list[str]:
    """Identifiers of common styles, as labelled samples of ordinary ones."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        words = [WORDS[int(j)] for j in rng.integers(len(WORDS), size=int(rng.integers(1, 5)))]
        number = str(int(rng.choice([rng.integers(10), rng.integers(100), rng.integers(1900, 2100), rng.integers(1_000_000)])))
        style = i % 6
        if style == 0:
            s = "_".join(words) + f"_{number}"
        elif style == 1:
            s = words[0] + "".join(w.title() for w in words[1:]) + number
        elif style == 2:
            s = "-".join([*words, number])
        elif style == 3:
            s = "/".join(words) + f"/{number}.{WORDS[int(rng.integers(len(WORDS)))][:3]}"
        elif style == 4:
            s = "_".join(w.upper() for w in words) + f"={number}"
        else:
            s = f"{number}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 32)):02d}"
        out.append(s)
    return out


def random_samples(n: int = SAMPLES, seed: int = SEED) -> list[str]:
    """Uniform strings over the alphabets of common credentials, as labelled samples of random ones."""
    rng = np.random.default_rng(seed)
    kinds = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "abcdef0123456789")
    return ["".join(np.array(list(kinds[i % len(kinds)]))[rng.integers(len(kinds[i % len(kinds)]), size=int(rng.integers(16, 64)))]) for i in range(n)]


def conditional(counts: np.ndarray) -> np.ndarray:
    """P(character | two before) from counts of triples, smoothed by shorter contexts."""
    c = counts.reshape(K, K, K).astype(float)
    c[:, :, 0] = 0
    zero = (c.sum(axis=(0, 1)) + 1) / (c.sum() + K)
    pair = c.sum(axis=0)
    one = (pair + BACK * zero) / (pair.sum(axis=1, keepdims=True) + BACK)
    return ((c + BACK * one[None]) / (c.sum(axis=2, keepdims=True) + BACK)).reshape(-1)


def count_of(samples: list[str]) -> np.ndarray:
    code = codes("\n\n".join(samples))
    return np.bincount(triples(code)[code[2:] > 0], minlength=K**3)


@dataclass
class Models:
    """``ratio`` holds log P(character | two before, random) - log P(the same, ordinary) a triple."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        return float(self.ratio[triples(codes(token))].sum())

    def secrets(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, float]]:
        """The candidates outside ``base`` that are secrets, with their log-likelihood ratios."""
        out, open_ = [], sorted((a, b) for a, b, _ in base)
        for m in CANDIDATE.finditer(text):
            a, b, token = m.start(), m.end(), m[0]
            if not any(map(str.isdigit, token)) or not any(map(str.isalpha, token)):
                continue
            if any(x < b and a < y for x, y in open_):
                continue
            s = self.score(token)
            if s >= TOTAL and s >= EACH * len(token) and len(set(token)) >= DIFFERENT:
                out.append((a, b, s))
        return out


def mixed(corpus: np.ndarray, samples: np.ndarray) -> np.ndarray:
    if not corpus.any():
        return conditional(samples)
    return SHARE * conditional(corpus) + (1 - SHARE) * conditional(samples)


def learn(docs: DataFrame, text_col: str = "text") -> Models:
    """The models of a table: counts over all of its texts, summed in Spark. At most 2 * K**3 counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, K**3), np.int64)
        for batch in batches:
            for some in slices(pd.Series(batch.column(0).to_pylist(), dtype=object)):
                text = "\n\n".join(some)  # no pattern crosses a line's end
                code = codes(text)
                kind = np.zeros(len(code) - 2, bool)
                for a, b, _ in base_spans(text):
                    kind[a:b] = True
                three, live = triples(code), code[2:] > 0
                total[0] += np.bincount(three[live & ~kind], minlength=K**3)
                total[1] += np.bincount(three[live & kind], minlength=K**3)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind * K**3 + at), pa.array(total[kind, at])], ["cell", "n"])
        give_back()

    rows = docs.select(F.col(text_col)).filter(F.col(text_col).isNotNull()).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(2 * K**3)
    total[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    ordinary, chance = mixed(total[: K**3], count_of(ordinary_samples())), mixed(total[K**3 :], count_of(random_samples()))
    return Models(np.log(chance) - np.log(ordinary))


def find_secrets(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``, an array of (start, end, kind, score) by start, then kind as in ALL_KINDS, replacing a column of
    that name. Starts and ends count code points, ends are exclusive; score is the log-likelihood ratio of kind ``random``
    and null for the base kinds. Null texts have none; rows stay as they are, repeats too; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                base = base_spans(text) if isinstance(text, str) else []
                added = shared.value.secrets(text, base) if isinstance(text, str) else []
                every = [(a, ALL_KINDS.index(k), b, None) for a, b, k in base] + [(a, len(KINDS), b, s) for a, b, s in added]
                out.append([{"start": a, "end": b, "kind": ALL_KINDS[k], "score": s} for a, k, b, s in sorted(every, key=lambda s: s[:3])])
            yield pd.Series(out, dtype=object)
        give_back()

    return docs.drop("secrets").withColumn("secrets", find(F.col(text_col)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`find_secrets` of ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_random, the number of
    spans that the models add. Null texts count as empty; rows that repeat have a row each."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs.select("doc_id", "text"), learn(docs)).select("doc_id", "secrets")
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in ALL_KINDS]
    base = F.filter("secrets", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *counts[:-1], F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("secrets")).alias("spans"), counts[-1])
