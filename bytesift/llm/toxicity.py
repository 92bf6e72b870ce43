"""Toxicity by compression distance.

zstandard trains dictionaries on labelled text: one on ordinary texts, and one on each half of the toxic
texts, of short segments for words and of longer ones for phrases. Windows of a text, each of its words and
runs of several, are compressed with them.
A window's gain is its compressed length with the ordinary dictionary less the longer of those with the
toxic ones: what a half holds by chance, the other seldom holds. A document's score is a logistic function
of how many windows gain how much, calibrated on ordinary texts that no dictionary was trained on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import crc_bucket_col, with_fields, worker_cache
from bytesift.storage import materialise, release

WORD = re.compile(r"[^\W\d_]+")
#: Longer words are cut into parts of so many characters.
LONGEST_WORD = 40
#: A window is a word, or so many words; how far apart the latter begin.
PHRASE, STEP = 8, 8
#: What both dictionaries hold and every window ends with: zstandard stores what has no match as it is.
FRAME = "|=window frame=|"
CUT = 0.7
#: Windows are counted by their gain in bytes; larger gains count as the largest.
GAINS = 24
THRESHOLDS = (2, 3, 4, 5, 6)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: list[bytes] = field(default_factory=list)  # for words
    phrases: list[bytes] = field(default_factory=list)  # toxic ones of longer segments, for phrases
    weights: list[float] = field(default_factory=lambda: [-6.0])


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if words and len(max(words, key=len)) > LONGEST_WORD:
        words = [w[k : k + LONGEST_WORD] for w in words for k in range(0, len(w), LONGEST_WORD)]
    return words


def _runs(texts: list[str]) -> list[bytes]:
    """Distinct runs of words, cut after words that their hash picks: copies of a passage are learned from once."""
    runs: dict[bytes, None] = {}
    for text in texts:
        held: list[str] = []
        for w in words_of(text):
            held.append(w)
            if len(held) == 32 or len(held) > 1 and zlib.crc32(w.encode()) % 8 == 0:
                runs[f" {' '.join(held)} ".encode()] = None
                held = []
        if held:
            runs[f" {' '.join(held)} ".encode()] = None
    return list(runs)


def dictionary(texts: list[str], size: int, segment: int = 16) -> bytes:
    """A dictionary that zstandard trains on the texts, of segments of about so many bytes; text that is too little to train on is one itself."""
    import zstandard as zs

    runs = _runs(texts)
    if sum(map(len, runs)) <= size:
        return b"".join(runs)
    try:
        return zs.train_dictionary(size, [r for r in runs if len(r) >= 8], k=segment, d=8).as_bytes()
    except zs.ZstdError:  # few long runs
        return b"".join(runs)[-size:]


class Gains:
    """How many windows of a text have which gain: a row for words and one for phrases."""

    def __init__(self, model: Model):
        self.ordinary = self.coder(model.ordinary) if model.toxic else None
        self.toxic, self.phrases = ([self.coder(d) for d in held] for held in (model.toxic, model.phrases))
        self.met: set[str] = set()
        self.gains: dict[str, int] = {}  # of the few words with a gain over 0

    @staticmethod
    def coder(content: bytes):
        import zstandard as zs

        held = zs.ZstdCompressionDict(content + FRAME.encode(), dict_type=zs.DICT_TYPE_RAWCONTENT)
        how = zs.ZstdCompressionParameters.from_level(
            9, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, window_log=19, hash_log=17, chain_log=17, search_log=5, min_match=4, strategy=zs.STRATEGY_BTLAZY2
        )
        held.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=held, compression_params=how)

    @staticmethod
    def lengths(coder, framed: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, coder.multi_compress_to_buffer(framed, threads=1)), np.int64, len(framed))

    def of_windows(self, windows: list[str], toxic: list) -> np.ndarray:
        """Gains, none below 0; a toxic dictionary is asked about what still gains after those before it."""
        framed = [f" {w} {FRAME}".encode() for w in windows]
        gains = np.zeros(len(framed), np.int64)
        if not framed:
            return gains
        left, usual, most = np.arange(len(framed)), self.lengths(self.ordinary, framed), None
        for coder in toxic:
            gain = usual[left] - self.lengths(coder, [framed[k] for k in left])
            most = gain if most is None else np.minimum(most, gain)
            left, most = left[most > 0], most[most > 0]
            if not len(left):
                return gains
        gains[left] = np.minimum(most, GAINS)
        return gains

    def __call__(self, words: list[str]) -> np.ndarray:
        counts = np.zeros((2, GAINS + 1), np.int64)
        for at in range(0, len(words) if self.ordinary else 0, 50_000):
            part = words[at : at + 50_000]
            distinct = set(part)
            new = list(distinct.difference(self.met))
            if len(self.met) > 500_000:
                self.met, self.gains = distinct.difference(new), {w: g for w, g in self.gains.items() if w in distinct}
            found = self.of_windows(new, self.toxic)
            self.gains.update((new[k], int(found[k])) for k in np.flatnonzero(found))
            self.met.update(new)
            if found := [self.gains[w] for w in part if w in self.gains]:
                counts[0] += np.bincount(found, minlength=GAINS + 1)
            after = words[at : at + 50_000 + PHRASE - 1]
            phrases = [" ".join(after[k : k + PHRASE]) for k in range(0, max(1, len(after) - PHRASE + STEP), STEP)]
            counts[1] += np.bincount(self.of_windows(phrases, self.phrases), minlength=GAINS + 1)
        return counts


def features(counts: np.ndarray, n_words: int) -> list[float]:
    """For words and for phrases: the largest gain, the mean of the three largest, how many windows are over each threshold, in all and in a hundred words.

    A text's length alone isn't told: without a gain all are 0.
    """
    out: list[float] = []
    for row in counts:
        over = row[::-1].cumsum()[::-1]  # windows with at least that gain
        out += [float((over[1:] > 0).sum()), float(np.minimum(over[1:], 3).sum()) / 3]
        for t in THRESHOLDS:
            out += [float(np.log1p(over[t])), float(np.log1p(100 * over[t] / max(1, n_words)))]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_size: int = 24 << 10, ordinary_size: int = 400_000) -> Model:
    """Dictionaries and weights. With fewer than two toxic or three ordinary texts: a model that scores all near 0.

    The toxic dictionaries are small, so they hold what is frequent in their texts; the ordinary one is large,
    so it holds what is ordinary among that. Every third ordinary text is kept for calibration only; a toxic text was
    learned from by one of the two halves, and the other bounds its gains.
    """
    model = Model()
    if len(toxic) < 2 or len(ordinary) < 3:
        return model
    model.ordinary = dictionary([t for k, t in enumerate(ordinary) if k % 3], ordinary_size)
    model.toxic = [dictionary(toxic[h::2], toxic_size) for h in range(2)]
    model.phrases = [dictionary(toxic[h::2], toxic_size, 32) for h in range(2)]
    gains, apart = Gains(model), ordinary[::3]
    x = [features(gains(words), len(words)) for words in map(words_of, toxic + apart)]
    model.weights = logistic(np.array(x), np.r_[np.ones(len(toxic)), np.zeros(len(apart))]).tolist()
    return model


def training_texts(docs: DataFrame, labels: DataFrame, text: str = "text", toxic_rows: int = 1500, ordinary_rows: int = 6000, longest: int = 60_000) -> tuple[list[str], list[str]]:
    """Texts of at most so many labelled rows of each class, those whose ids hash lowest; empty texts and those over ``longest`` characters aren't learned from and take no other row's place.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are used. Of an id that repeats the first text in order is learned from.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket_col("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col(text).alias("t")).where((F.length("t") > 0) & (F.length("t") <= longest))
    usable = materialise(usable.join(texts.select("doc_id"), "doc_id", "left_semi"), "learnable")
    picked = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, ordinary_rows))]
    few = picked[0].unionByName(picked[1])
    # of an id that repeats, one text: what reaches the driver is bounded by the rows picked
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).collect()
    release(usable)
    rows.sort(key=lambda r: (r["doc_id"], r["t"]))
    return [r["t"] for r in rows if r["toxic"] == 1], [r["t"] for r in rows if r["toxic"] == 0]


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 if score >= 0.7) and n_windows (its words) of every whole text.

    Null and empty texts have no window and get the score of that. Columns of these names in ``docs`` are
    replaced, others pass through; repeated rows stay; an empty table: an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = ("toxicity", hash((*model.toxic, *model.phrases, tuple(model.weights))))

    @F.pandas_udf("score double, n_windows long")
    def of(texts: pd.Series) -> pd.DataFrame:
        gains, m = worker_cache(key, lambda: Gains(held.value)), held.value
        weights = np.array(m.weights)
        z, n = [], []
        for t in texts:
            words = words_of(t)
            z.append(weights[0] + (np.dot(weights[1:], features(gains(words), len(words))) if len(weights) > 1 else 0))
            n.append(len(words))
        z = np.clip(np.array(z, dtype=float), -30, 30)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "n_windows": n})

    scored = of.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))
    return with_fields(docs, scored, {"score": None, "predicted": (F.col("made.score") >= CUT).cast("int"), "n_windows": None})
