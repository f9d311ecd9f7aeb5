"""Language of every word by a linear-chain conditional random field.

A word's score for each language adds up weights of hashed features: the word itself (the
lexicon), prefixes, suffixes and letter n-grams.  Learned transitions tie neighbouring words, and
forward-backward gives each word's distribution, so code-switched texts get one
language per stretch and a text gets the mean over its words.

The field is fitted on a sample of labelled documents that is bounded for each language; texts of different languages are
strung together in training, so that the transitions see switches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldwise.llm.common import byte_slices, fold_of, released

FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS = 400  # expected sample per language
SAMPLE_CHARS = 4_000_000  # of the sampled texts of one language
SAMPLE_PIECE = SAMPLE_CHARS // SAMPLE_DOCS  # of one text; of a longer one, a run of so many at a place drawn from the id
BITS = 17  # hashed feature space
PIECE = 24  # words from one text before training goes on with another
EPOCHS, BATCH, STEP, DECAY = 3, 64, 0.15, 1e-7
BLOCK = 64  # words per block of the forward and backward passes
KNOWN_WORDS = 100_000
TAG_BYTES = 1 << 18  # of text whose words are labelled at a time; each takes some ten numbers per language
UNKNOWN = "und"
CARRIED = ("lang_pred string", "score double", "certainty double")
ADDED_TYPES = ("lang_pred string", "score double", "n_words long", "shares map<string,double>", "stretches array<struct<lang:string,words:long>>")


def split_words(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of words of each text, and the words of all texts: lower-case runs of letters."""
    spaced = pc.utf8_lower(pc.replace_substring_regex(pa.array(texts, pa.string()), r"\P{L}+", " "))
    lists = pc.split_pattern(spaced, " ")
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return ends[bounds[1:]] - ends[bounds[:-1]], flat.filter(pa.array(real)).dictionary_encode()


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    """A feature number from the parts that name a feature."""
    h = np.zeros(1, np.uint64)
    for part in parts:
        h = (h + np.asarray(part, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all features: the word itself, its letter 1- to 3-grams (those at its ends are
    marked, and are its shorter affixes), and its affixes of three and four letters."""
    framed = [f"^{w}$" for w in words]
    code = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = starts[1:][owner] - np.arange(len(code))  # letters from here to the end of the word
    found = []
    for n in (1, 2, 3):
        at = np.flatnonzero(left >= n)
        found.append((owner[at], hashed(n, *(code[at + i] for i in range(n)))))
    for kind, n, at in ((4, 4, starts[:-1]), (5, 4, starts[1:] - 4), (6, 5, starts[1:] - 5)):
        long = np.flatnonzero(sizes > n)
        found.append((long, hashed(kind, *(code[at[long] + i] for i in range(n)))))
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
    if len(words):
        found.append((np.arange(len(words)), hashed(7, np.add.reduceat(code * powers[np.arange(len(code)) - starts[:-1][owner]], starts[:-1]))))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


@dataclass
class Field:
    """labels, weights (features x labels, scaled by the number of features) and transitions in logs."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores of words: the mean of their features' weights, times ten."""
    owner, feature = word_features(words)
    sizes = np.bincount(owner, minlength=len(words))
    sums = [np.bincount(owner, weights[feature, j], len(words)) for j in range(weights.shape[1])]
    return 10.0 * np.stack(sums, axis=1) / np.maximum(sizes, 1)[:, None]


def _batch_gradient(scores: np.ndarray, gold: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Gradients of the log likelihood of sequences of equal length (batch x time x labels)."""
    count, time, labels = scores.shape
    move = np.exp(transitions)
    peak = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - peak)
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    alpha[:, 0] = np.exp(start) * emit[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, time):
        alpha[:, t] = alpha[:, t - 1] @ move * emit[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    beta[:, -1] = 1.0
    for t in range(time - 2, -1, -1):
        beta[:, t] = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
        beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pair = np.einsum("bti,btj->btij", alpha[:, :-1], beta[:, 1:] * emit[:, 1:]) * move
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    one_hot = np.eye(labels)[gold]
    seen = np.einsum("bti,btj->ij", one_hot[:, :-1], one_hot[:, 1:])
    return one_hot - marginal, seen - pair.sum(axis=(0, 1)), (one_hot[:, 0] - marginal[:, 0]).sum(axis=0)


def fit_field(texts: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """Maximum likelihood by AdaGrad over (text, label) pairs; None without a labelled word."""
    labels = sorted({label for _, label in texts})
    rng = np.random.default_rng(seed)
    counts, coded = split_words([text for text, _ in texts])
    if not len(coded):
        return None
    each = np.split(coded.indices.to_numpy(), np.cumsum(counts)[:-1])
    pieces = [(words[i : i + PIECE], labels.index(label)) for words, (_, label) in zip(each, texts) for i in range(0, len(words), PIECE)]
    owner, feature = word_features(coded.dictionary.to_pylist())
    flat = feature[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    k, length = len(labels), 2 * PIECE
    weights, squares = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-3)
    transitions, start = np.zeros((k, k)), np.zeros(k)
    move_squares, start_squares = np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        words = np.concatenate([pieces[i][0] for i in order]).astype(np.int64)
        gold = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
        pad = -len(words) % length
        words, gold = (np.concatenate([x, x[np.arange(pad) % len(x)]]).reshape(-1, length) for x in (words, gold))
        for at in range(0, len(words), BATCH):
            used, where = np.unique(words[at : at + BATCH], return_inverse=True)
            parts = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(sizes[used])[:-1]]), sizes[used]) + np.arange(sizes[used].sum())
            features, heads = flat[parts], np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            scores = 10.0 * np.add.reduceat(weights[features], heads, axis=0) / sizes[used][:, None]
            shape = words[at : at + BATCH].shape
            error, moved, begun = _batch_gradient(scores[where.ravel()].reshape(*shape, k), gold[at : at + BATCH], transitions, start)
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, where.ravel(), error.reshape(-1, k))
            per_feature = np.repeat(10.0 * per_word / sizes[used][:, None], sizes[used], axis=0)
            rows, inverse = np.unique(features, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, per_feature[:, j], len(rows)) for j in range(k)], axis=1) / shape[0] - DECAY * weights[rows]
            squares[rows] += gradient**2
            weights[rows] += STEP * gradient / np.sqrt(squares[rows])
            moved, begun = moved / shape[0], begun / shape[0]
            move_squares += moved**2
            start_squares += begun**2
            transitions += STEP * moved / np.sqrt(move_squares)
            start += STEP * begun / np.sqrt(start_squares)
    return Field(labels, weights.astype(np.float32), transitions, start)


def marginals(scores: np.ndarray, bounds: np.ndarray, field: Field) -> np.ndarray:
    """Distribution of every word given its whole text.  scores: all words of all texts, end to end;
    bounds: where texts begin and end (none empty).

    Texts are cut into blocks of BLOCK words.  The product of each block's matrices is taken for all
    blocks at once; the vectors that enter each block follow from the products before and after
    it, and the passes inside the blocks then run for all blocks at once.
    """
    k = scores.shape[1]
    move = np.exp(field.transitions)
    lengths = np.diff(bounds)
    blocks_of = -(-lengths // BLOCK)
    text_of = np.repeat(np.arange(len(lengths)), blocks_of)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    begin = bounds[:-1][text_of] + BLOCK * (np.arange(len(text_of)) - first_block[:-1][text_of])
    size = np.minimum(BLOCK, bounds[1:][text_of] - begin)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    padded = np.ones((len(begin), BLOCK, k))
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    padded[inside] = emit
    rank = np.arange(len(begin)) - first_block[:-1][text_of]
    after = first_block[1:][text_of] - 1 - np.arange(len(begin))
    heads = rank == 0
    product = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t in range(int(size.max(initial=0))):  # row vector times product: one step of the forward pass
        step = product @ move
        if t == 0:
            step[heads] = np.exp(field.start)
        step *= padded[:, t][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where((t < size)[:, None, None], step, product)
    enter, leave = np.empty((len(begin), k)), np.empty((len(begin), k))
    for r in range(int(blocks_of.max(initial=0))):
        now = np.flatnonzero(rank == r)
        if r == 0:
            enter[now] = 1.0 / k
        else:
            vector = np.einsum("bi,bij->bj", enter[now - 1], product[now - 1])
            enter[now] = vector / vector.sum(axis=1, keepdims=True)
        now = np.flatnonzero(after == r)
        if r == 0:
            leave[now] = 1.0
        else:
            vector = np.einsum("bij,bj->bi", product[now + 1], leave[now + 1])
            leave[now] = vector / vector.sum(axis=1, keepdims=True)
    alpha, beta = np.empty_like(padded), np.empty_like(padded)
    vector = enter
    for t in range(BLOCK):
        moved = vector @ move
        if t == 0:
            moved[heads] = np.exp(field.start)
        vector = moved * padded[:, t]
        vector /= vector.sum(axis=1, keepdims=True)
        alpha[:, t] = vector
    vector = leave
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = vector
        stepped = (vector * padded[:, t]) @ move.T
        stepped /= stepped.sum(axis=1, keepdims=True)
        vector = np.where((t < size)[:, None], stepped, leave)
    both = (alpha * beta)[inside]
    return both / both.sum(axis=1, keepdims=True)


class Tagger:
    """Labels words of texts inside a task; remembers the scores of words."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.field.labels)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, emissions(new, self.field.weights).astype(np.float32)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words per text, and the distribution of every word."""
        counts, coded = split_words(texts)
        if not len(coded):
            return counts, np.zeros((0, len(self.field.labels)))
        rows = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = np.concatenate([[0], np.cumsum(counts[counts > 0])])
        return counts, marginals(self.scores[rows], bounds, self.field)


def training_sample(docs: DataFrame, train: Column, docs_per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """Labelled (text, lang) rows of the fold: about docs_per_language rows of each language, by a hash of
    the id (of the text where the id is null), with at most SAMPLE_PIECE characters of a text and SAMPLE_CHARS of a
    language.  A row that does not fit is skipped; every language has a row."""
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_language / n))).otherwise(share)
    key = F.coalesce("doc_id", F.xxhash64("text"))
    chosen = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)
    start = F.pmod(F.xxhash64(key, F.lit(5)), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_PIECE + 1))
    piece = F.substring("text", (start + 1).cast("int"), F.lit(SAMPLE_PIECE)).alias("piece")
    running, out = dict.fromkeys(counts, 0), []
    for row in labelled.where(chosen).select("lang", piece, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "piece", "lang").toLocalIterator():
        if running[row["lang"]] + len(row["piece"]) <= SAMPLE_CHARS:
            running[row["lang"]] += len(row["piece"])
            out.append((row["piece"], row["lang"]))
    if absent := sorted(set(counts) - {lang for _, lang in out}):
        least = F.min_by(piece, F.struct(F.xxhash64(key, F.lit(3)).alias("h"), piece)).alias("piece")
        out += [(r["piece"], r["lang"]) for r in labelled.where(F.col("lang").isin(absent)).groupBy("lang").agg(least).orderBy("lang").collect()]
    return out


def fit_on(docs: DataFrame) -> Field | None:
    return fit_field(training_sample(docs, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))


def detect_languages(docs: DataFrame, field: Field | None = None, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, n_words, shares, stretches; with `carry`
    row (the other columns of docs), text, lang_pred, score and certainty.

    shares: mean probability of each learned language over the words.  lang_pred has the largest share
    (the first in the alphabet of equal ones), score is that share.  certainty:
    mean over the words of the largest probability of each, which texts in several languages keep high.  stretches: (lang, words) of runs of
    words with the same most probable language.  Null texts and texts without a letter: 'und', 0,
    no words.  Without a labelled row to learn from everything is 'und'.
    """
    field = field if field is not None else fit_on(docs)
    held = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keep = docs.select("text", F.struct(*others).alias("row")) if carry else docs.select("doc_id", "text", held)
    passed = ["row", "text"] if carry else ["doc_id", "held_out"]
    # 2 ** BITS rows of one weight per language; plain arrays, which executors can open without this package
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(field).values()) if field else None)
    added = T.StructType.fromDDL(", ".join(CARRIED if carry else ADDED_TYPES)).fields
    names_of = [f.name for f in added]
    stretch = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Field(*shared.value) if shared.value else None
        tagger = Tagger(known) if known else None
        for whole in batches:
            for batch in byte_slices(whole, "text", TAG_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                counts, spread = tagger.tag(texts) if tagger else (np.zeros(len(texts), np.int64), np.zeros((0, 1)))
                names, scores, shares, runs, sure = [], [], [], [], []
                ends = np.cumsum(counts)
                best, largest = spread.argmax(axis=1), spread.max(axis=1)
                for count, end in zip(counts.tolist(), ends.tolist()):
                    if not count:
                        names.append(UNKNOWN), scores.append(0.0), shares.append({}), runs.append([]), sure.append(0.0)
                        continue
                    mean = spread[end - count : end].mean(axis=0)
                    top, own = int(mean.argmax()), best[end - count : end]
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [count]]).tolist()
                    names.append(known.labels[top])
                    scores.append(min(1.0, float(mean[top])))
                    sure.append(min(1.0, float(largest[end - count : end].mean())))
                    shares.append(dict(zip(known.labels, mean.tolist())))
                    runs.append([{"lang": known.labels[int(own[a])], "words": b - a} for a, b in zip(cuts, cuts[1:])])
                new = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                if carry:
                    new.append(pa.array(sure, pa.float64()))
                else:
                    new += [pa.array(counts, pa.int64()), pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64())), pa.array(runs, stretch)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *new], [*passed, *names_of])

    schema = T.StructType([keep.schema[c] for c in passed] + added)
    return keep.mapInArrow(released(run), schema)
