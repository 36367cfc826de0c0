"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled: its emission scores are the sums of learned weights of its features (the word
itself, affixes of one to three bytes, and byte bigrams and trigrams), neighbouring labels are tied by learned
transitions, and forward-backward gives each word's distribution, so stretches in another language are labelled
as such. A text's language is the one with the largest mean marginal, and that mean is its score.

Words are runs of ASCII letters and non-ASCII characters, ASCII and Latin-1 letters lower-cased. A text is one chain. It is worked on in
blocks of CHAIN words, which hand each other their forward and backward messages until these settle, so labels don't depend on where blocks end.

The model is fitted on a bounded sample: about SAMPLE_DOCS labelled documents of each language, chosen by a hash of
the doc_id, and of each up to SAMPLE_WORDS words in runs spread over the whole text. So that transitions mean
something, training chains join runs of different languages.

Texts that are null or have no letters get `und` and score 0. Rows with null lang or null text are not learned from.
With nothing to learn from every text gets `und`. Repeated rows are predicted alike; ties go to the language that sorts first.
Columns of the input that have the names of the new ones are replaced. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD_BYTES, hash_words, mix, pieces, segment

#: Bounds of what the fit sees.
SAMPLE_DOCS, SAMPLE_WORDS, RUN = 800, 96, 12
#: Languages at most; more distinct labels are an error in the data.
LANGUAGES = 256
CHAIN = 64
#: Change of a message between blocks that no longer counts.
SETTLED = 1e-6
#: Rows of the weight table: trigrams, bigrams, affixes and words share the last part.
CODES = 64
TRIGRAMS, HASHED = CODES**3, 1 << 18
FEATURES = TRIGRAMS + HASHED

#: Bytes of a word, digits apart.
LETTER_BYTES = WORD_BYTES.copy()
LETTER_BYTES[0x30:0x3A] = 0
#: A small number for each byte: letters have their own, other bytes share 36.
_CODE = np.zeros(256, np.int32)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 36


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of the Latin-1 letters, whose UTF-8 begins with C3."""
    if len(data) < 2:
        return data
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    if len(up):
        data = data.copy()
        data[up] += 0x20
    return data


class Words:
    """The words of some texts and the rows of their features."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        # A byte between texts, so that no feature sees the text beside.
        data, at = np.insert(data, at[1:], 0), at + np.arange(len(at))
        self.mapped, self.starts, self.ends, self.word_at = segment(_lower(data), at, LETTER_BYTES)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of all n-gram features, first of each word): a bigram and a trigram for each byte; a word's ends count as a byte 0."""
        code = np.zeros(len(self.mapped) + 3, np.int32)
        code[2:-1] = _CODE[self.mapped]
        n = self.ends - self.starts
        # A word of n bytes has the n + 1 trigrams that end at its bytes and behind it.
        inside = self.mapped != 0
        where = np.zeros(len(self.mapped) + 1, bool)
        where[:-1] = inside
        where[self.ends] = True
        k = np.flatnonzero(where)
        second = code[k + 1]
        first = np.where(second == 0, 0, code[k])
        return (first * CODES + second) * CODES + code[k + 2], np.searchsorted(k, self.starts), n

    def affixes(self) -> np.ndarray:
        """Rows of the other features: the word, its first and its last one to three bytes."""
        out = np.empty((len(self.starts), 7), np.int64)
        out[:, 0] = TRIGRAMS + (hash_words(self.mapped, self.starts, self.ends) % np.uint64(HASHED)).astype(np.int64)
        n = self.ends - self.starts
        front = back = np.zeros(len(n), np.uint64)
        for k in range(3):
            front = front * np.uint64(257) + np.where(n > k, self.mapped[np.minimum(self.starts + k, self.ends - 1)], 0).astype(np.uint64)
            back = back * np.uint64(257) + np.where(n > k, self.mapped[np.maximum(self.ends - 1 - k, self.starts)], 0).astype(np.uint64)
            for j, x in ((1, front), (4, back)):
                out[:, j + k] = TRIGRAMS + (mix(x * np.uint64(8) + np.uint64(j + k)) % np.uint64(HASHED)).astype(np.int64)
        return out


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each language."""
    if not len(words.starts):
        return np.zeros((0, weights.shape[1]), np.float32)
    grams, first, _ = words.grams()
    out = np.add.reduceat(weights[grams], first, axis=0)
    rest = words.affixes()
    for k in range(rest.shape[1]):
        out += weights[rest[:, k]]
    return out


def forward_backward(scores: np.ndarray, length: np.ndarray, transition: np.ndarray, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scores: chains x places x labels, of which each chain has its first `length` places; entry and leave: factors from what is before and behind the chains.

    Returns marginals, expected transitions, log partition, and the messages that chains send ahead and back.
    """
    chains, places, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, a = np.exp(scores - top).astype(np.float64), np.exp(transition).astype(np.float64)
    forward = np.empty((chains, places, labels))
    scale = np.ones((chains, places))
    now = e[:, 0] if entry is None else e[:, 0] * entry
    for t in range(places):
        if t:
            now = (forward[:, t - 1] @ a) * e[:, t]
        scale[:, t] = now.sum(axis=1)
        forward[:, t] = now / scale[:, t, None]
    live = np.arange(places) < length[:, None]
    end = np.ones((chains, labels)) if leave is None else leave
    backward = end
    marginal = np.empty_like(forward)
    pairs = np.zeros((labels, labels))
    for t in range(places - 1, -1, -1):
        marginal[:, t] = forward[:, t] * backward
        if t:
            ahead = e[:, t] * backward / scale[:, t, None]
            pairs += (forward[:, t - 1] * live[:, t, None]).T @ (ahead * live[:, t, None])
            backward = np.where(live[:, t, None], ahead @ a.T, end)
    marginal /= marginal.sum(axis=2, keepdims=True)
    ahead, back = forward[np.arange(chains), length - 1] @ a, (e[:, 0] * backward) @ a.T
    return marginal, pairs * a, ((np.log(scale) + top[:, :, 0]) * live).sum(axis=1), ahead / ahead.sum(axis=1, keepdims=True), back / back.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition

    def label(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, number of words before each text)."""
        words = Words(data, at)
        scores, word_at = emissions(words, self.weights), words.word_at
        count = np.diff(word_at)
        chains = -(-count // CHAIN)
        if not len(scores):
            return scores, word_at
        # Place of each word in a grid of blocks.
        row_at = np.cumsum(chains) - chains
        doc = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(scores)) - word_at[:-1][doc]
        row, place = row_at[doc] + k // CHAIN, k % CHAIN
        length = np.bincount(row, minlength=int(chains.sum()))
        first = np.searchsorted(row, np.arange(len(length)))
        out = np.empty_like(scores)
        owner = np.repeat(np.arange(len(count)), chains)
        joined = owner[1:] == owner[:-1]
        # What comes from the block before and from the one behind; at a text's ends it says nothing.
        labels = scores.shape[1]
        entry, leave = np.ones((2, len(length), labels)) / labels
        todo = np.arange(len(length))
        while len(todo):
            sent = np.empty((2, len(todo), labels))
            order = np.argsort(length[todo], kind="stable")
            i = 0
            while i < len(order):
                # Blocks of like lengths together, so that short ones aren't filled up.
                shortest = int(length[todo[order[i]]])
                j = min(len(order), i + 2048, int(np.searchsorted(length[todo[order]], max(shortest + 4, shortest * 5 // 4), "right")))
                mine = todo[order[i:j]]
                size = length[mine]
                words_of = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                r, p = np.repeat(np.arange(j - i), size), place[words_of]
                grid = np.zeros((j - i, int(size.max()), labels), np.float32)
                grid[r, p] = scores[words_of]
                marginal, _, _, sent[0, order[i:j]], sent[1, order[i:j]] = forward_backward(grid, size, self.transition, entry[mine], leave[mine])
                out[words_of] = marginal[r, p]
                i = j
            on, back = todo[(todo < len(length) - 1)], todo[todo > 0]
            on, back = on[joined[on]], back[joined[back - 1]]
            to_next, to_last = sent[0, np.searchsorted(todo, on)], sent[1, np.searchsorted(todo, back)]
            news = np.zeros(len(length), bool)
            news[on + 1] |= np.abs(entry[on + 1] - to_next).max(axis=1, initial=0) > SETTLED
            news[back - 1] |= np.abs(leave[back - 1] - to_last).max(axis=1, initial=0) > SETTLED
            entry[on + 1], leave[back - 1] = to_next, to_last
            todo = np.flatnonzero(news)
        return out, word_at

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        marginal, word_at = self.label(data, at)
        total = np.zeros((len(marginal) + 1, len(self.languages)))
        np.cumsum(marginal, axis=0, out=total[1:])
        count = np.diff(word_at)
        mean = (total[word_at[1:]] - total[word_at[:-1]]) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        ok = count > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist(), strict=True)], np.where(ok, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)


def _sums(weights: np.ndarray, gram_row: np.ndarray, first: np.ndarray, rest_row: np.ndarray, i: int, j: int) -> np.ndarray:
    """Scores of the words i to j."""
    end = first[j] if j < len(first) else len(gram_row)
    return np.add.reduceat(weights[gram_row[first[i] : end]], first[i:j] - first[i], axis=0) + weights[rest_row[i:j]].sum(axis=1)


def fit(samples: list[tuple[str, str]], epochs: int = 14, rate: float = 0.15, penalty: float = 1e-6, seed: int = 7) -> Model | None:
    """Learns weights and transitions from (language, run of words) by Adam on the chains' log-likelihood."""
    languages = sorted({k for k, _ in samples})
    if not languages:
        return None
    number, rng = {k: n for n, k in enumerate(languages)}, np.random.default_rng(seed)
    raw = [t.encode() for _, t in samples]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    count, labels = np.diff(words.word_at), np.array([number[k] for k, _ in samples])
    grams, first, _ = words.grams()
    size = np.diff(first, append=len(grams))
    rest = words.affixes()
    # Chains: runs of the same language mostly, of another now and then.
    order = rng.permutation(len(samples))
    order = order[np.argsort(labels[order] * 8 + rng.integers(0, 3 * 8, len(order)), kind="stable")]
    order = order[count[order] > 0]
    flat = np.concatenate([np.arange(words.word_at[k], words.word_at[k + 1]) for k in order]) if len(order) else np.zeros(0, np.int64)
    if not len(flat):
        return None
    label = np.repeat(labels[order], count[order])
    places = min(CHAIN, len(flat))
    chains = -(-len(flat) // places)
    grid = np.full(chains * places, -1, np.int64)
    grid[: len(flat)] = flat
    truth = np.zeros(chains * places, np.int64)
    truth[: len(flat)] = label
    length = np.full(chains, places)
    length[-1] = len(flat) - (chains - 1) * places
    live = (grid >= 0).reshape(chains, places)
    truth = truth.reshape(chains, places)

    used, row = np.unique(np.concatenate([grams, rest.ravel()]), return_inverse=True)
    row = row.astype(np.int32)
    gram_row, rest_row = row[: len(grams)], row[len(grams) :].reshape(rest.shape)
    n, k = len(used), len(languages)
    weights, transition = np.zeros((n, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, transition, transition)]
    word_of_gram = np.repeat(np.arange(len(size), dtype=np.int32), size)
    both = live[:, 1:] & live[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    for epoch in range(1, epochs + 1):
        scores = np.concatenate([_sums(weights, gram_row, first, rest_row, i, min(i + 20_000, len(first))) for i in range(0, len(first), 20_000)])
        chain = np.zeros((chains * places, k))
        chain[: len(flat)] = scores[flat]
        marginal, pairs, *_ = forward_backward(chain.reshape(chains, places, k), length, transition)
        wrong = -marginal
        wrong[np.arange(chains)[:, None], np.arange(places), truth] += 1
        wrong[~live] = 0
        error = np.zeros((len(scores), k))
        np.add.at(error, flat, wrong.reshape(-1, k)[: len(flat)])
        up = np.stack([np.bincount(gram_row, error[word_of_gram, c], n) + np.bincount(rest_row.ravel(), np.repeat(error[:, c], rest.shape[1]), n) for c in range(k)], axis=1) / len(flat) - penalty * weights
        for x, g, m, v in ((weights, up, state[0], state[1]), (transition, (seen - pairs) / len(flat) - penalty * transition, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    table = np.zeros((FEATURES, k), np.float32)
    table[used] = weights
    return Model(languages, table, transition.astype(np.float32))


def spread(text: str, words: int = SAMPLE_WORDS, run: int = RUN) -> list[str]:
    """Runs of words from all over the text, `words` at most."""
    parts = text.split()
    runs = max(1, words // run)
    if len(parts) <= words:
        return [" ".join(parts[k : k + run]) for k in range(0, len(parts), run)]
    step = len(parts) / runs
    return [" ".join(parts[int(k * step) : int(k * step) + run]) for k in range(runs)]


def learn(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fits a model on the sample of the rows of `docs` (doc_id, text, lang) for which `train` is true."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    # A hash of the row picks it with the share that leaves about sample_docs of its language.
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])[F.col("lang")]
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    picked = known.withColumn("place", place).where(F.col("place") < share).select("lang", "place", "text")
    runs = picked.mapInArrow(_runs, "place double, lang string, run string")
    # The bound holds for tables of many repeated rows, too, whose hashes are equal.
    runs = runs.orderBy("place", "lang", "run").limit(2 * sample_docs * len(counts) * -(-SAMPLE_WORDS // RUN))
    return fit([(lang, run) for lang, _, run in sorted((r["lang"], r["place"], r["run"]) for r in runs.collect())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(place, lang, run) for lang, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for run in spread(text)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.float64(), pa.string(), pa.string()), strict=True)], names=["place", "lang", "run"])


def _letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, text: str = "text", language: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Adds the predicted language and its score to every row."""
    docs = docs.drop(language, score)
    if model is None:
        return docs.withColumns({language: F.lit("und"), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    position = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(position)):
                part = batch.slice(i, j - i)
                found, value = shared.value.predict(data, at)
                # Non-ASCII characters count as parts of words; only texts without ASCII letters need a look at what they are.
                ascii_letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data | 0x20) - np.uint8(97) < 26, out=ascii_letter[1:])
                for k in np.flatnonzero(ascii_letter[at[1:]] == ascii_letter[at[:-1]]).tolist():
                    if not _letters(part.column(position)[k].as_py()):
                        found[k], value[k] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(value, pa.float64())], names=[*names, language, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)
