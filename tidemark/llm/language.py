"""Language identification by a linear-chain conditional random field over the words of a text.

Each word of a (possibly code-switched) text gets a label. Its features are hashed character n-grams of two to four
bytes with the word's edges (so that prefixes and suffixes are features of their own) and its entry in a lexicon of
words that are frequent in the training texts. Transitions between labels are learned. The forward-backward recursion gives each word's posterior
for each label; the text gets the label with the largest mean posterior, and that mean as its score.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be
learned; every language is learned, however many there are, and texts of any length are drawn and learned whole; copies are labelled alike; training rows with a null text or label are skipped; columns besides the text are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words

#: Training rows of each language at most, taken by a hash of the id, and of all languages together (but one of each).
SAMPLE, ROWS = 300, 24_000
#: Bytes of training text of each language at most, and of all languages together (but one text of each). Texts are learned whole; one of more
#: than EVEN bytes is drawn more seldom, in inverse proportion to its length, so that a few long ones don't take the place of all others.
BYTES, ALL_BYTES, EVEN = 2 << 20, 64 << 20, 4096
#: Slots of the n-gram table and of the lexicon, for WIDE languages or fewer; with more of them slots are fewer, so that a model keeps its size.
BITS, LEXICON_BITS, WIDE = 17, 16, 64
#: Times that a word occurs in the training texts to enter the lexicon.
FREQUENT = 4
#: A text is in no learned language if the lexicon has less than STRANGE of the usual share of its words, and if a training text
#: would have so few in as many words with a chance below CHANCE. Shares of training texts are drawn to the usual one by LEAN words.
STRANGE, CHANCE, LEAN = 0.1, 1e-3, 10
#: Words whose emissions are held at once.
WORDS = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (slots, labels)
    tags: np.ndarray  # the word that a slot of the lexicon stands for
    lexicon: np.ndarray  # (slots, labels)
    start: np.ndarray
    moves: np.ndarray
    usual: float = 0.0  # the share of the training texts' words that the lexicon has
    shares: np.ndarray | None = None  # how many training texts have a share of so many hundredths


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with zeros between words, begin, end, text) of the words."""
    letter = _LETTER[data]
    begin, end, text = words.spans(letter, at)
    low = np.where(letter, words.lower(data), 0).astype(np.uint8)
    latin = np.flatnonzero(low[:-1] == 0xC3) + 1
    capital = latin[(low[latin] >= 0x80) & (low[latin] <= 0x9E) & (low[latin] != 0x97)]
    low[capital] += 0x20
    return low, begin, end, text


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray, slots: int = 1 << BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the n-grams, `slots` being a power of two, index of each word's first); each byte of a word and its end close n-grams of 2, 3 and 4 bytes."""
    size = end - begin + 1
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    at = inner + np.repeat(begin, size)
    last = inner == np.repeat(size, size) - 1
    byte = [np.where(last, 0, data[np.minimum(at, len(data) - 1)]).astype(np.uint64)]
    byte += [np.where(inner >= k, data[np.maximum(at - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3)]
    out = np.empty((len(at), 3), np.int32)
    value = byte[0]
    for k in (1, 2, 3):
        value = value | byte[k] << np.uint64(8 * k)
        # one byte before the word is its edge; an n-gram that begins further left is left out
        slot = (words.mix(value + np.uint64(k << 40)) >> np.uint64(65 - slots.bit_length())).astype(np.int32)
        out[:, k - 1] = np.where(inner >= k - 1, slot, 0)
    return out.ravel(), first * 3


def lexicon_slots(model: Model, word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(65 - len(model.tags).bit_length())).astype(np.int64)


def in_lexicon(model: Model, word: np.ndarray) -> np.ndarray:
    """Whether the lexicon has each word, given by its hash."""
    return model.tags[lexicon_slots(model, word)] == word


def chance(model: Model, n: np.ndarray, have: np.ndarray) -> np.ndarray:
    """A bound (Chernoff's) on the chance that the lexicon has `have` or fewer of n words of a text like the training texts."""
    seen = np.flatnonzero(model.shares)
    s, weight = np.clip((seen + 0.5) / 100, 0.005, 0.995), model.shares[seen] / model.shares.sum()
    q = (have / n)[:, None]
    far = np.where(q > 0, q * np.log(np.maximum(q, 1e-300) / s), 0) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-300) / (1 - s)), 0)
    return np.where(q < s, np.exp(-n[:, None] * far), 1) @ weight


def familiar(model: Model, n: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Whether texts of n words, of which the lexicon has `have`, are like the training texts; the fewer words, the more it takes to say no."""
    out = have >= STRANGE * model.usual * n
    few = np.flatnonzero(~out)
    out[few] = chance(model, n[few], have[few]) >= CHANCE
    return out


def emissions(model: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A score of each word for each label; equal words are scored once."""
    if not len(begin):
        return np.zeros((0, len(model.labels)), np.float32)
    word = words.hashes(data, begin, end)
    _, one, back = np.unique(word, return_index=True, return_inverse=True)
    out = np.empty((len(one), len(model.labels)), np.float32)
    for k in range(0, len(one), WORDS // 8):
        some = np.sort(one[k : k + WORDS // 8])
        order = np.argsort(one[k : k + WORDS // 8], kind="stable")
        slots, first = grams(data, begin[some], end[some], len(model.grams))
        table = np.empty((len(some), len(model.labels)), np.float32)
        for n in range(len(model.labels)):
            table[:, n] = np.add.reduceat(model.grams[:, n][slots], first)
        slot = lexicon_slots(model, word[some])
        table += model.lexicon[slot] * (model.tags[slot] == word[some])[:, None]
        out[k + order] = table
    return out[back]


def posteriors(model: Model, scores: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False):
    """Each word's posteriors by forward-backward, over sequences scores[first:first + size]; with pairs also the expected transitions.

    Sequences are taken in order of length, so that step t works on those that are longer than t.
    """
    labels = scores.shape[1]
    e = np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0)).astype(np.float64)
    moves, start = np.exp(model.moves), np.exp(model.start)
    out, total = np.zeros((len(scores), labels)), np.zeros((labels, labels))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    for group in np.array_split(order, max(1, len(order) // 512)) if len(order) else []:
        at, n = first[group], size[group]
        steps = int(n[0])
        live = np.searchsorted(-n, -np.arange(1, steps + 1), "right")
        a = start * e[at]
        a /= a.sum(1, keepdims=True)
        out[at] = a
        for t in range(1, steps):
            m = live[t]
            a = (a[:m] @ moves) * e[at[:m] + t]
            a /= a.sum(1, keepdims=True)
            out[at[:m] + t] = a
        b = np.ones((len(group), labels))
        for t in range(steps - 1, -1, -1):
            m = live[t]
            if t + 1 < steps:
                k = live[t + 1]
                x = b[:k] * e[at[:k] + t + 1]
                if pairs:
                    now = out[at[:k] + t]
                    total += moves * (now.T @ (x / ((now @ moves) * x).sum(1, keepdims=True)))
                b[:k] = x @ moves.T
                b[:k] /= b[:k].sum(1, keepdims=True)
            p = out[at[:m] + t] * b[:m]
            out[at[:m] + t] = p / p.sum(1, keepdims=True)
    return (out, total) if pairs else out


def train(texts: list[str], langs: list[str], rounds: int = 6, batch: int = 64, rate: float = 0.4) -> Model | None:
    """Maximises the conditional likelihood by adaptive gradient steps; every word of a text has the text's label."""
    names = sorted(set(langs))
    if not names:
        return None
    count = len(names)
    less = max(0, (-(-count // WIDE) - 1).bit_length())
    slots, entries = 1 << max(BITS - less, 10), 1 << max(LEXICON_BITS - less, 10)
    model = Model(names, np.zeros((slots, count)), np.zeros(entries, np.uint64), np.zeros((entries, count)), np.zeros(count), np.zeros((count, count)))
    data, at = words.utf8(pa.array(texts, pa.large_string()))
    data, begin, end, text = cut(data, at)
    word = words.hashes(data, begin, end)
    once, times = np.unique(word, return_counts=True)
    kept = once[np.argsort(times, kind="stable")][np.sort(times) >= FREQUENT]
    model.tags[lexicon_slots(model, kept)] = kept  # of words that meet in a slot, the most frequent
    model.usual = float(in_lexicon(model, word).mean()) if len(word) else 0.0
    size, first = words.place(text, len(texts))
    have = np.bincount(text, in_lexicon(model, word), len(texts))
    model.shares = np.bincount(((have + LEAN * model.usual) / (size + LEAN) * 100).astype(int), minlength=1)
    truth = np.array([names.index(x) for x in langs])
    sums = [np.full_like(x, 1e-2) for x in (model.grams, model.lexicon, model.start, model.moves)]

    def step(values: np.ndarray, sums: np.ndarray, at, gradient: np.ndarray) -> None:
        sums[at] += gradient**2
        values[at] += rate * gradient / np.sqrt(sums[at])

    rng = np.random.default_rng(11)
    for _ in range(rounds):
        # texts of a batch are alike in length, since the recursion takes as many steps as the longest has words; batches come in any order
        order = rng.permutation(len(texts))
        order = order[np.argsort(size[order], kind="stable")]
        for k in rng.permutation(-(-len(order) // batch)) * batch:
            docs = np.sort(order[k : k + batch])
            docs = docs[size[docs] > 0]
            if not len(docs):
                continue
            n = size[docs]
            mine = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            y = np.repeat(truth[docs], n)
            u, one, back = np.unique(word[mine], return_index=True, return_inverse=True)
            some = np.sort(mine[one])
            rank = np.empty(len(u), np.int64)
            rank[np.argsort(mine[one], kind="stable")] = np.arange(len(u))
            slots, at0 = grams(data, begin[some], end[some], len(model.grams))
            of = np.repeat(np.arange(len(some)), np.diff(np.append(at0, len(slots))))
            slot = lexicon_slots(model, word[some])
            known = model.tags[slot] == word[some]
            e = np.add.reduceat(model.grams[slots], at0, axis=0) + model.lexicon[slot] * known[:, None]
            posterior, moved = posteriors(model, e[rank[back]], np.cumsum(n) - n, n, pairs=True)
            error = -posterior
            error[np.arange(len(y)), y] += 1
            error /= len(docs)
            by_word = np.stack([np.bincount(rank[back], error[:, c], len(some)) for c in range(count)], 1)
            used = np.unique(slots)
            place = np.searchsorted(used, slots)
            step(model.grams, sums[0], used, np.stack([np.bincount(place, by_word[of, c], len(used)) for c in range(count)], 1))
            step(model.lexicon, sums[1], slot[known], by_word[known])
            seen = np.diag(np.bincount(truth[docs], n - 1, count))
            step(model.moves, sums[3], ..., (seen - moved) / len(docs))
            step(model.start, sums[2], ..., (np.bincount(truth[docs], minlength=count) - posterior[np.cumsum(n) - n].sum(0)) / len(docs))
    model.grams, model.lexicon = model.grams.astype(np.float32), model.lexicon.astype(np.float32)
    return model


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE, total: int = ROWS) -> Model | None:
    """A model of the languages of the labelled rows, learned on at most `rows` texts of each language and about `total` in all.

    Texts are learned whole. They are taken by a hash of the id until a language has its share of bytes; its first one is taken
    at any length, so the driver gets ALL_BYTES at most, and one text of each language. Of rows that share an id one is learned.
    """
    fair = F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull()
    docs = docs.where(fair).select(F.col(id).alias("_i"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
    size = F.octet_length("_t").cast("long")
    keys = docs.select("_i", "_l", size.alias("_n"), F.greatest(F.lit(1.0), size / EVEN).alias("_long"))
    counts = keys.groupBy("_l").agg(F.sum(1 / F.col("_long")).alias("even")).collect()  # one row for each language
    if not counts:
        return None
    rows, room = max(1, min(rows, total // len(counts))), min(BYTES, ALL_BYTES // len(counts))
    # a share of each language by hash, about twice what is asked for, so that the window gets few rows however many there are
    share = keys.sparkSession.createDataFrame([(c["_l"], 2 * rows / c["even"] + 50 / c["even"]) for c in counts], "_l string, _share double")
    part = F.pmod(F.xxhash64(F.lit(1), "_i"), F.lit(1 << 30)) / float(1 << 30) * F.col("_long")
    chosen = keys.withColumn("_part", part).join(F.broadcast(share), "_l").where("_part < _share")
    chosen = chosen.groupBy("_l", "_i").agg(F.max("_n").alias("_n"), F.min("_part").alias("_part"))
    turn = Window.partitionBy("_l").orderBy("_part", "_i")
    chosen = chosen.withColumn("_k", F.row_number().over(turn)).withColumn("_sum", F.sum("_n").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.where((F.col("_k") <= rows) & ((F.col("_k") == 1) | (F.col("_sum") <= room))).select("_i").distinct()
    got = docs.join(F.broadcast(chosen), "_i").groupBy("_i").agg(F.min(F.struct("_t", "_l")).alias("_x")).select("_i", "_x._t", "_x._l").toArrow()
    got = sorted(zip(*(got.column(k).to_pylist() for k in range(3)), strict=True))
    return train([t for _, t, _ in got], [c for _, _, c in got])


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, label, posterior) of each word of a text: the fine result for code-switched text."""
    data, at = words.utf8(pa.array([text], pa.large_string()))
    low, begin, end, _ = cut(data, at)
    if not len(begin):
        return []
    p = posteriors(model, emissions(model, low, begin, end), np.array([0]), np.array([len(begin)]))
    raw = data.tobytes()
    return [(raw[a:b].decode(errors="replace"), model.labels[k], float(x)) for a, b, k, x in zip(begin, end, p.argmax(1), p.max(1), strict=True)]


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128), dtype=np.int32)])
    high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int32)])
    out = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for k in np.flatnonzero(~out & (high[at[1:]] > high[at[:-1]])):
        out[k] = any(c.isalpha() for c in data[at[k] : at[k + 1]].tobytes().decode(errors="replace"))
    return out


def predict(df: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """df with the predicted label and its score; columns of these names are replaced.

    With `known`, that column says of each text whether its words are those of a learned language (see `familiar`).
    """
    added = [label, score, *([known] if known else [])]
    fields = [f for f in df.schema if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sure, like = [], [], []
            for _, data, at in words.parts(batch.column(text)):
                count = len(at) - 1
                if model is None:
                    found += ["und"] * count
                    sure += [0.0] * count
                    like += [False] * count
                    continue
                low, begin, end, doc = cut(data, at)
                n, first = words.place(doc, count)
                p = posteriors(model, emissions(model, low, begin, end), first, n)
                mean = np.stack([np.bincount(doc, p[:, c], count) for c in range(len(model.labels))], 1) / np.maximum(n, 1)[:, None]
                good = _letters(data, at) & (n > 0)
                found += [model.labels[k] if g else "und" for k, g in zip(mean.argmax(1), good, strict=True)]
                sure += np.where(good, np.minimum(mean.max(1), 1), 0.0).tolist()
                if known:
                    have = np.bincount(doc, in_lexicon(model, words.hashes(low, begin, end)), count)
                    like += (good & familiar(model, n, have)).tolist()
            columns = [pa.array(found, pa.string()), pa.array(sure, pa.float64()), *([pa.array(like, pa.bool_())] if known else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), *added])

    types = [f"`{n}` {t}" for n, t in zip(added, ("string", "double", "boolean"), strict=False)]
    return df.mapInArrow(words.trimmed(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *types]))
