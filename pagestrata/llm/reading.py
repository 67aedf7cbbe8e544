"""Reading level of documents from sentence-level classifiers.

Every sentence is placed on an ordered scale of levels by an ordinal classifier whose score is the sum of two regularised
linear models, a character model (hashed character trigrams of each word) and a word model (hashed words), and of a
term of the sentence's length. They are trained on a bounded, documented sample of pages whose sentences are labelled by the
reading-ease formula. The sentences' level distributions, once weighted by words and once each alike, are averaged and
calibrated to the document's reading ease. The margin of that estimate comes from held-out pages. Documents whose estimate lies
above the limit of difficult texts by more than it are settled by the models; the others are the candidates, and for them alone the
formula over the whole text follows as the exact check.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.rows import map_rows
from pagestrata.runtime import one_delivery

# Reading ease (not held to 0..100) at which one level of a sentence ends and the next begins.
# The wide ones at the low end hold menus and lists that no mark ends.
LEVEL_EDGES = (-1500.0, -1000.0, -700.0, -500.0, -400.0, -300.0, -250.0, -200.0, -160.0, -130.0, -100.0, *(float(x) for x in range(-80, 121, 10)))
DIFFICULT, VERY_DIFFICULT = 30.0, 10.0
# Names of documents' levels by their reading ease, from the hardest.
LEVELS = ((0.0, "specialist"), (10.0, "very_difficult"), (30.0, "difficult"), (50.0, "fairly_difficult"), (70.0, "standard"), (90.0, "easy"), (float("inf"), "very_easy"))
SAMPLE_PAGES = 800
CHARACTER_FEATURES = 1 << 14
WORD_FEATURES = 1 << 13
RIDGE = 1e-6
EPOCHS = 150
RATE = 0.2
# Over which part of a level's width the chance of the next level rises.
SLOPE = 0.3
LONGEST_SENTENCE = 40
# The margin is the worst miss of the held-out half of the sample times SAFETY; it shrinks as the root of the words, to LEAST_MARGIN points.
SAFETY = 1.5
LEAST_MARGIN = 4.0
KNOWN_WORDS = 500_000

_ASCII = re.compile(r"[^a-z]+")
_VOWELS = re.compile(r"[aeiouy]+")
_ENDS = re.compile(r"[.!?]+")


def syllables(word: str) -> int:
    """Syllables of a word by its ASCII letters: none 0, up to three letters 1, else vowel runs less a final e, at least 1."""
    letters = _ASCII.sub("", word.lower())
    if not letters:
        return 0
    if len(letters) <= 3:
        return 1
    return max(1, len(_VOWELS.findall(letters)) - letters.endswith("e"))


def latin_text(text: str) -> bool:
    """At least ten letters, half of them or more ASCII or of the Latin blocks up to U+024F."""
    if text.isascii():
        return sum(map(str.isalpha, text)) >= 10
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= 10 and 2 * sum(c < "\x80" or "À" <= c <= "ɏ" for c in letters) >= len(letters)


def ease_of(words: int, sentences: int, syllable_count: int) -> float:
    return min(100.0, max(0.0, 206.835 - 1.015 * words / sentences - 84.6 * syllable_count / words))


def reading_ease(text: str | None) -> float | None:
    """Reading ease of a whole text, 0..100; None where it cannot be measured."""
    words = (text or "").split()
    if not words or not latin_text(text):
        return None
    sentences = max(1, len(_ENDS.findall(text)))
    if len(words) // sentences > LONGEST_SENTENCE:
        return None
    return ease_of(len(words), sentences, sum(map(syllables, words)))


def word_features(word: str) -> tuple[list[int], int]:
    """Hashed character trigrams of a word's ASCII letters, and its hash as a whole."""
    w = f"^{_ASCII.sub('', word.lower())}$".encode()
    grams = [zlib.crc32(w[i : i + 3]) % CHARACTER_FEATURES for i in range(max(1, len(w) - 2))]
    return grams, zlib.crc32(w) % WORD_FEATURES


def sentences_of(text: str) -> list[list[str]]:
    return [w for s in _ENDS.split(text) if (w := s.split())]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _length_features(lengths: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(lengths)), lengths / 20.0], axis=1)


def _slopes() -> np.ndarray:
    widths = np.diff(np.array(LEVEL_EDGES))
    return SLOPE * np.append(widths, widths[-1])


class SentenceModel:
    """Ordinal classifier of sentences: character model plus word model plus sentence length on one scale, cut at the level edges."""

    def __init__(self, chars: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.chars, self.words, self.rest = chars, words, rest
        # Worst miss of a held-out text times the root of its words.
        self.calibration, self.miss = np.zeros(2 * (len(LEVEL_EDGES) + 1)), 1e9

    def word_score(self, word: str) -> float:
        grams, whole = word_features(word)
        return float(self.chars[grams].sum() + self.words[whole])

    def scores(self, by_word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of sentences, in points of reading ease, given each word's score in order and the sentences' lengths."""
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return 10.0 * (np.add.reduceat(by_word, starts) / lengths + _length_features(lengths) @ self.rest)

    def distributions(self, scores: np.ndarray) -> np.ndarray:
        """Chance of each level for each sentence."""
        above = _sigmoid((scores[:, None] - np.array(LEVEL_EDGES)) / _slopes())
        edge = np.ones((len(scores), 1))
        return np.concatenate([edge, above], axis=1) - np.concatenate([above, 0 * edge], axis=1)


def mixed_levels(levels: np.ndarray, lengths: np.ndarray, owners: np.ndarray, documents: int) -> np.ndarray:
    """Level distributions of documents: the mean over their words, then the mean over their sentences. owners ascend."""
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    both = []
    for sentences in (levels * lengths[:, None], levels):
        out = np.zeros((documents, levels.shape[1]))
        sums = np.add.reduceat(sentences, starts)
        out[owners[starts]] = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
        both.append(out)
    return np.concatenate(both, axis=1)


def train(texts: list[str]) -> SentenceModel | None:
    """Fit the sentence models on labelled texts, and the calibration of documents on the same; None without usable text."""
    texts = [t for t in texts if reading_ease(t) is not None]
    ids: dict[str, int] = {}
    flat, lengths, labels, owner, spoken = [], [], [], [], []
    for k, text in enumerate(texts):
        for words in sentences_of(text):
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
                    spoken.append(syllables(w))
            x = [ids[w] for w in words]
            flat.extend(x)
            lengths.append(len(words))
            labels.append(206.835 - 1.015 * len(words) - 84.6 * sum(spoken[i] for i in x) / len(words))
            owner.append(k)
    if not labels:
        return None
    flat, lengths, owner = np.array(flat), np.array(lengths), np.array(owner)
    label = np.searchsorted(LEVEL_EDGES, labels, side="right")
    features = [word_features(w) for w in ids]
    gram = np.concatenate([np.array(g) for g, _ in features])
    gram_word = np.repeat(np.arange(len(features)), [len(g) for g, _ in features])
    gram_starts = np.flatnonzero(np.diff(gram_word, prepend=-1))
    whole = np.array([w for _, w in features])
    n = len(label)
    sentence_of = np.repeat(np.arange(n), lengths)
    extra = _length_features(lengths)
    model = SentenceModel(np.zeros(CHARACTER_FEATURES), np.zeros(WORD_FEATURES), np.zeros(2))
    weights = (model.chars, model.words, model.rest)
    squares = [np.full_like(w, 1e-10) for w in weights]
    pace = [np.zeros_like(w) for w in weights]
    edges, slopes = np.array(LEVEL_EDGES, np.float32), _slopes().astype(np.float32)
    for epoch in range(EPOCHS):
        by_word = np.add.reduceat(model.chars[gram], gram_starts) + model.words[whole]
        score = model.scores(by_word[flat], lengths)
        # Cumulative logistic loss: each edge asks whether the sentence lies beyond it.
        error = (_sigmoid((score.astype(np.float32)[:, None] - edges) / slopes).sum(axis=1) - label) / n
        on_word = np.bincount(flat, (error / lengths)[sentence_of], len(features))
        gradients = (np.bincount(gram, on_word[gram_word], CHARACTER_FEATURES) + RIDGE * model.chars, np.bincount(whole, on_word, WORD_FEATURES) + RIDGE * model.words, extra.T @ error)
        rate = RATE * (1 + np.cos(np.pi * epoch / EPOCHS)) / 2
        for weight, gradient, square, drift in zip(weights, gradients, squares, pace):
            square *= 0.99
            square += 0.01 * gradient * gradient
            drift *= 0.9
            drift += 0.1 * gradient
            weight -= rate * drift / (np.sqrt(square) + 1e-8)
    by_word = np.add.reduceat(model.chars[gram], gram_starts) + model.words[whole]
    mixed = mixed_levels(model.distributions(model.scores(by_word[flat], lengths)), lengths, owner, len(texts))
    ease = np.array([_raw_ease(t) for t in texts])
    size = np.bincount(owner, lengths, len(texts))
    usable = size > 0
    mixed, ease, size = mixed[usable], ease[usable], size[usable]
    half = np.arange(len(ease)) % 2 == 0

    def fit(rows: np.ndarray) -> np.ndarray:
        x = mixed[rows]
        # Ridge towards the sentences' mean of the levels' middles, so that levels the sample lacks keep a meaning.
        middle = np.concatenate([0 * _level_middles(), _level_middles()])
        return middle + np.linalg.solve(x.T @ x + 0.02 * np.eye(x.shape[1]), x.T @ (ease[rows] - x @ middle))

    model.calibration = fit(np.arange(len(ease)))
    if half.any() and not half.all():
        model.miss = float((np.abs(mixed[~half] @ fit(half) - ease[~half]) * np.sqrt(size[~half])).max())
    return model


def _level_middles() -> np.ndarray:
    edges = np.array(LEVEL_EDGES)
    return np.concatenate([[edges[0] - 5], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 5]])


def _raw_ease(text: str) -> float:
    """Reading ease before it is held to 0..100."""
    words = text.split()
    return 206.835 - 1.015 * len(words) / max(1, len(_ENDS.findall(text))) - 84.6 * sum(map(syllables, words)) / len(words)


def sample_texts(pages: DataFrame, text_column: str, id_column: str, size: int = SAMPLE_PAGES) -> list[str]:
    """At most `size` texts: those whose ids have the smallest hashes. Ids are chosen first, so texts of others stay unread by the sort."""
    chosen = pages.where(F.length(text_column) > 0).select(id_column).distinct().orderBy(F.xxhash64(F.lit("reading"), id_column)).limit(size)
    ids = [r[0] for r in chosen.collect()]
    return [r[0] for r in one_delivery(pages.where(F.col(id_column).isin(ids)), id_column, [text_column]).select(text_column).collect()] if ids else []


class _Words:
    """Model scores of the words a worker has met."""

    def __init__(self, model: SentenceModel):
        self.model, self.known = model, {}

    def __call__(self, words: list[str]) -> list[float]:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.model.word_score(w)
        return [known[w] for w in words]


def levels(pages: DataFrame, id_column: str = "page_id", text_column: str = "body_text") -> DataFrame:
    """(id, words, level, level_shares, difficulty, margin, settled_by, reading_ease, band) of each id with a text, each once.

    level_shares is the mean level distribution of the sentences by words, difficulty the calibrated reading ease it
    implies. settled_by is "models" where difficulty lies more than margin above the limit of difficult texts, else "formula":
    only then reading_ease holds the exact value. band is that of texts below the limit. All are null where a
    text cannot be measured (no words, few or mostly non-Latin letters, over forty words a sentence). Null ids and null texts are
    dropped; an empty table gives an empty result.
    """
    given = pages.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    model = train(sample_texts(given, text_column, id_column)) or SentenceModel(np.zeros(CHARACTER_FEATURES), np.zeros(WORD_FEATURES), np.zeros(2))
    schema = "id long, words int, level string, level_shares array<float>, difficulty double, margin double, settled_by string, reading_ease double, band string"
    names = [x.split()[0] for x in schema.split(", ")]
    carried = pages.sparkSession.sparkContext.broadcast(model)
    lookup: list[_Words] = []

    def over(c: dict[str, list]) -> dict[str, list]:
        m = carried.value
        if not lookup:
            lookup.append(_Words(m))
        flat, lengths, owners, measured, counts = [], [], [], [], []
        for k, text in enumerate(c["text"]):
            words = text.split()
            counts.append(len(words))
            measured.append(bool(words) and latin_text(text))
            if not measured[-1]:
                continue
            parts = sentences_of(text)
            if len(words) // max(1, len(_ENDS.findall(text))) > LONGEST_SENTENCE:
                measured[-1] = False
            else:
                flat.extend(w for p in parts for w in p)
                lengths.extend(map(len, parts))
                owners.extend([k] * len(parts))
        n = len(counts)
        mixed = np.zeros((n, 2 * (len(LEVEL_EDGES) + 1)))
        if flat:
            sizes = np.array(lengths)
            mixed = mixed_levels(m.distributions(m.scores(np.array(lookup[0](flat)), sizes)), sizes, np.array(owners), n)
        estimate = mixed @ m.calibration
        rows = []
        for k, text in enumerate(c["text"]):
            if not measured[k]:
                rows.append((c["id"][k], counts[k], *[None] * 7))
                continue
            e, margin = float(estimate[k]), max(LEAST_MARGIN, SAFETY * m.miss / counts[k] ** 0.5)
            clear = e >= DIFFICULT + margin
            exact = None if clear else reading_ease(text)
            value = e if clear else exact
            band = None if value >= DIFFICULT else "readability_difficult" if value >= VERY_DIFFICULT else "readability_very_difficult"
            level = next(name for limit, name in LEVELS if value < limit or limit == float("inf"))
            rows.append((c["id"][k], counts[k], level, mixed[k, : len(LEVEL_EDGES) + 1].astype(np.float32).tolist(), e, margin, "models" if clear else "formula", exact, band))
        return dict(zip(names, map(list, zip(*rows)))) if rows else {name: [] for name in names}

    measured = map_rows(given.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), over, schema)
    return one_delivery(measured, "id", names).withColumnRenamed("id", id_column)


def found(pages: DataFrame) -> DataFrame:
    """Pages that the models cannot place above the limit and that the formula places below it."""
    return levels(pages).where(F.col("band").isNotNull()).select("page_id", "band")
