"""Languages of documents and of their lines, with calibrated confidence and rejection.

A line is the average of its words, a word the average of its hashed subwords (3 to 5 letters with word ends, and the word
itself), each an embedding; a linear softmax on top. Embeddings and softmax are trained by stochastic gradient descent in numpy on
lines of a bounded sample of labelled documents. A tenth of the rare lines is held out beforehand. Labels may be wrong and documents
mixed, so a first model throws out lines that it firmly places elsewhere, and a second one is trained on the rest; its temperature is
then fitted on the held-out lines, which no model has seen or chosen, with a share of wrong labels fitted along. A line
whose probability is below ``REJECT``, or that is no prose, has no language.

Training reads at most ``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_CHARS`` characters, those of lowest hash, so it is the same in every
run; every line of every document is then scored. A model can be fitted once, saved, and given to any number of jobs.

Defined cases: null, empty and blank texts and lines have no language; lines without three words of letters, or mostly of
figures, signs, code or markup, are no prose; labels that name no known language count as missing; a null id is kept;
very long texts are scored line by line; repeated texts are scored alike; without labelled documents nothing has a language.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import spread

LANGUAGES = ["de", "en", "es", "fr", "nl", "pt"]
#: Codes and names under which the languages go.
NAMES = {
    "en": "en eng english englisch anglais ingles inglês engels",
    "de": "de deu ger german deutsch allemand aleman alemao duits",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais holandes vlaams",
    "fr": "fr fra fre french francais französisch franzosisch frans frances",
    "es": "es spa spanish espanol spanisch espagnol spaans espanhol castellano",
    "pt": "pt por portuguese portugues portugiesisch portugais portugees",
}
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 20_000
BUCKETS, DIM = 1 << 15, 16
EPOCHS, BATCH, RATE = 6, 128, 0.5
#: Steps that few lines are trained for as well.
LEAST_STEPS = 800
REJECT = 0.4
#: A first model's probability from which another language than the label counts as firm.
FIRM = 0.8
#: Times a line must occur to be believed without a first model.
OFTEN = 5
#: Words kept with their embeddings, at most.
KEPT = 200_000
#: Runs of letters that no digit or underscore touches.
WORD = re.compile(r"(?<![\w])[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w])")
INVISIBLE = regex.compile(r"(?!\s)\p{C}")
TAG = re.compile(r"<[^<>]*>|&#?\w+;")
CODE_SIGN = re.compile(r"[{}\[\]|=<>\\_^~`(]")
CODE = re.compile(r"[{}\[\]|=<>\\_^~`]|\w+\(\w*\)")


def label_of(lang: Column) -> Column:
    """The known language that a label names, or null."""
    plain = F.translate(F.lower(F.trim(lang)), "áàâãäçéèêëíìîïñóòôõöúùûü", "aaaaaceeeeiiiinooooouuuu")
    first = F.regexp_extract(plain, "^[a-z]+", 0)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(first.isin(names.split()), code).otherwise(out)
    return F.when(lang.isNotNull(), out)


def words_of(line: str) -> list[str]:
    """The normalised words of a line; none if it is no prose."""
    text = html.unescape(line)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if not text.isprintable():
        text = INVISIBLE.sub("", text)
    bare = TAG.sub(" ", text) if "<" in text or "&" in text else text
    words = [w.lower() for w in WORD.findall(bare)]
    long = [w for w in words if len(w) > 1]
    if len(long) < 3:
        return []
    solid = len("".join(bare.split()))
    letters = sum(map(len, words))
    if letters < 0.6 * solid or (CODE_SIGN.search(bare) and len(CODE.findall(bare)) > 0.1 * len(words) + 1):
        return []
    return words


def buckets_of(word: str) -> list[int]:
    """The hashed subwords of a word."""
    marked = f"^{word}$"
    parts = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(p.encode()) & (BUCKETS - 1) for p in sorted(parts)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then the same of start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


def summed(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, in order, and the sum of the rows of each."""
    # Places are few enough for 16 bits as a rule, which are sorted by digits.
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")
    there = at[order]
    first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
    return there[first], np.add.reduceat(rows[order], first, axis=0)


class Model:
    """Embeddings of subwords and a linear softmax."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.weight = np.zeros((DIM, len(LANGUAGES)), np.float32)
        self.temperature = 1.0
        self.ids: dict[str, int] = {}
        self.vectors = np.zeros((0, DIM), np.float32)

    def __getstate__(self) -> dict:
        return {"embedding": self.embedding, "weight": self.weight, "temperature": self.temperature}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ids, self.vectors = {}, np.zeros((0, DIM), np.float32)

    def fit(self, lines: list[list[str]], labels: np.ndarray, often: np.ndarray, seed: int = 7) -> None:
        """Stochastic gradient descent; lines that occur often and lines of rare languages are drawn more often."""
        rng = np.random.default_rng(seed)
        words = sorted({w for line in lines for w in line})
        at = {w: i for i, w in enumerate(words)}
        parts = [buckets_of(w) for w in words]
        n_parts = np.array([len(p) for p in parts])
        flat = np.concatenate([np.array(p) for p in parts]) if parts else np.zeros(0, int)
        start = np.concatenate([[0], np.cumsum(n_parts)])
        n_words = np.array([len(line) for line in lines])
        in_lines = np.array([at[w] for line in lines for w in line])
        line_at = np.cumsum(n_words) - n_words
        counts = np.bincount(labels, minlength=len(LANGUAGES))
        share = np.sqrt(often / np.maximum(counts, 1)[labels])
        share = share / share.sum()
        steps = max(LEAST_STEPS, EPOCHS * len(lines) // BATCH)
        for step in range(steps):
            pick = rng.choice(len(lines), BATCH, p=share)
            size = n_words[pick]
            joined = in_lines[ragged(line_at[pick], size)]
            used, inverse = np.unique(joined, return_inverse=True)
            cells = flat[ragged(start[used], n_parts[used])]
            bounds = np.concatenate([[0], np.cumsum(n_parts[used])[:-1]])
            word_vec = np.add.reduceat(self.embedding[cells], bounds) / n_parts[used][:, None]
            line_start = np.concatenate([[0], np.cumsum(size)[:-1]])
            line_vec = np.add.reduceat(word_vec[inverse], line_start) / size[:, None]
            score = line_vec @ self.weight
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), labels[pick]] -= 1
            rate = RATE * (1 - step / steps)
            back = p @ self.weight.T / size[:, None]
            self.weight -= (rate * line_vec.T @ p / BATCH * 8).astype(np.float32)
            grad = summed(np.repeat(back, size, axis=0), inverse)[1] / n_parts[used][:, None]
            touched, total = summed(np.repeat(grad, n_parts[used], axis=0), cells)
            self.embedding[touched] -= rate * total

    def raw_scores(self, lines: list[list[str]]) -> np.ndarray:
        """The softmax layer's input for each line; lines must have words."""
        if not lines:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        if len(self.ids) > KEPT:
            self.ids, self.vectors = {}, np.zeros((0, DIM), np.float32)
        fresh = sorted({w for line in lines for w in line if w not in self.ids})
        if fresh:
            made = np.stack([self.embedding[buckets_of(w)].mean(0) for w in fresh])
            for i, w in enumerate(fresh, len(self.vectors)):
                self.ids[w] = i
            self.vectors = np.concatenate([self.vectors, made])
        size = np.array([len(x) for x in lines])
        index = np.fromiter((self.ids[w] for line in lines for w in line), np.int64, int(size.sum()))
        vec = np.add.reduceat(self.vectors[index], np.concatenate([[0], np.cumsum(size)[:-1]])) / size[:, None]
        return vec @ self.weight

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """Probabilities of each line; lines must have words."""
        return probabilities(self.raw_scores(lines), self.temperature)


def probabilities(raw: np.ndarray, temperature: float) -> np.ndarray:
    """The softmax of scores at a temperature."""
    p = np.exp((raw - raw.max(1, keepdims=True)) / temperature) if len(raw) else raw
    return p / p.sum(1, keepdims=True)


def calibrated(model: Model, lines: list[list[str]], labels: np.ndarray) -> None:
    """The temperature that makes the labels of held-out lines most probable, some share of which is taken to be wrong.

    The lines are not chosen by any model, so wrong labels are among them; their share is fitted along with the temperature."""
    chance = (np.bincount(labels, minlength=len(LANGUAGES)) / max(1, len(labels)))[labels]
    raw, at = model.raw_scores(lines), np.arange(len(labels))
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.125, 8, 49):
        right = probabilities(raw, float(temperature))[at, labels]
        wrong = 0.1
        for _ in range(100):  # the likeliest share of wrong labels at this temperature
            wrong = float(np.mean(wrong * chance / np.maximum((1 - wrong) * right + wrong * chance, 1e-12)))
        loss = -np.log(np.maximum((1 - wrong) * right + wrong * chance, 1e-9)).mean()
        best = min(best, (loss, float(temperature)))
    model.temperature = best[1]


def sampled_lines(df: DataFrame, key: str, text: str, lang: str) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct prose lines of the sample, the label that most of their documents have, how often they occur, and with what share of it."""
    label = label_of(F.col(lang))
    own = df.select(F.col(text).alias("t"), label.alias("l"), F.xxhash64(F.col(key), F.length(text)).alias("h")).filter(F.col("l").isNotNull() & (F.length("t") > 0) & (F.length("t") <= SAMPLE_CHARS))
    votes: dict[tuple[str, ...], np.ndarray] = {}
    for row in own.orderBy("h", "t").limit(SAMPLE_DOCS).toLocalIterator():
        for line in row["t"].split("\n"):
            if words := words_of(line):
                votes.setdefault(tuple(words), np.zeros(len(LANGUAGES)))[LANGUAGES.index(row["l"])] += 1
    counts = np.array([v.sum() for v in votes.values()])
    return [list(w) for w in votes], np.array([int(v.argmax()) for v in votes.values()], int), counts, np.array([v.max() / v.sum() for v in votes.values()])


def trained(lines: list[list[str]], labels: np.ndarray, often: np.ndarray, share: np.ndarray) -> Model | None:
    """The model, from lines whose labels may be wrong; None without lines.

    A line that occurs often with one label most of the time is believed; others must not be placed elsewhere by a first model.
    """
    if not lines:
        return None
    # A tenth of the lines that are rare is held out before anything is learned; lines that occur often are all learned from.
    held = np.flatnonzero(often < OFTEN)[::10]
    seen = np.setdiff1d(np.arange(len(lines)), held)
    if len(held) < 10:
        held, seen = np.arange(len(lines)), np.arange(len(lines))
    first = Model()
    first.fit([lines[i] for i in seen], labels[seen], often[seen])
    p = first.scores([lines[i] for i in seen])
    sure = (p.argmax(1) == labels[seen]) | (p.max(1) < FIRM) | ((often[seen] >= OFTEN) & (share[seen] >= 0.5))
    train = seen[sure]
    model = Model()
    model.fit([lines[i] for i in train], labels[train], often[train])
    calibrated(model, [lines[i] for i in held], labels[held])
    return model


def fitted(df: DataFrame, text: str, lang: str, key: str) -> Model | None:
    """The model of the documents ``df``, to be given to ``languages`` as often as wanted; None if no document has a label."""
    return trained(*sampled_lines(df, key, text, lang))


def saved(model: Model, path: str) -> None:
    """The model as a file that ``loaded`` reads again."""
    with open(path, "wb") as out:
        np.savez_compressed(out, embedding=model.embedding, weight=model.weight, temperature=model.temperature)


def loaded(path: str) -> Model:
    with np.load(path) as made:
        model = Model()
        model.embedding, model.weight, model.temperature = made["embedding"], made["weight"], float(made["temperature"])
    return model


def lines_of(df: DataFrame, key: str, text: str, keep: list[str], model: Model | None) -> DataFrame:
    """(key, keep, line_no, n_words, lang, confidence) of each line; lang is null where it is no prose or rejected."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    slim = spread(df.select(F.col(key).alias("__key"), *keep, F.col(text).alias("__text")).filter(F.col(text).isNotNull()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                at: list[int] = []
                number: list[int] = []
                words: list[list[str]] = []
                for i, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for k, line in enumerate(t.split("\n")):
                        at.append(i)
                        number.append(k)
                        words.append(words_of(line) if own is not None else [])
                prose = [i for i, w in enumerate(words) if w]
                lang: list[str | None] = [None] * len(at)
                sure: list[float | None] = [None] * len(at)
                if prose:
                    p = own.scores([words[i] for i in prose])
                    for i, best, value in zip(prose, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        sure[i] = value
                        lang[i] = LANGUAGES[best] if value >= REJECT else None
                index = pa.array(at, pa.int32())
                made = [c.take(index) for c in part.columns[:-1]]
                made += [pa.array(number, pa.int32()), pa.array([len(w) for w in words], pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, [*part.schema.names[:-1], "line_no", "n_words", "line_lang", "confidence"])

    out = slim.mapInArrow(run, f"{kinds}, line_no int, n_words int, line_lang string, confidence double")
    return out.withColumnRenamed("__key", key)


def languages(df: DataFrame, key: str, text: str, lang: str, model: Model | None = None) -> DataFrame:
    """(key, label, line_no, n_words, line_lang, confidence) of every line, by ``model`` or else one fitted to ``df`` itself."""
    model = model or fitted(df, text, lang, key)
    return lines_of(df.withColumn("label", label_of(F.col(lang))), key, text, ["label"], model)


def documents(lines: DataFrame, key: str) -> DataFrame:
    """(key, label, lang, confidence, mixed): each document's language, the one with most words, its lines weighed by confidence.

    Lines are summed for each language first, so a very long document is no more than one row for each language.
    """
    by_lang = lines.filter("line_lang IS NOT NULL").groupBy(key, "label", "line_lang").agg(F.sum(F.col("n_words") * F.col("confidence")).alias("w"), F.sum("n_words").alias("n"))
    best = F.max(F.struct("w", "line_lang"))
    return by_lang.groupBy(key, "label").agg(best["line_lang"].alias("lang"), (best["w"] / F.sum("n")).alias("confidence"), (F.count("*") > 1).alias("mixed"))
