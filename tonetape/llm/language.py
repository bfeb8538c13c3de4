"""Language of words and documents by a linear-chain conditional random field.

Words are the positions of the chain, languages the labels. A word's features are its letters, pairs and
triples of letters, and affixes of up to three letters (hashed into ``FEATURES`` weights per language), and
a lexicon: how often the word stands in each language's training documents, counted over all of them by
Spark in ``LEXICON`` hashed cells. Transitions are learned from chains that switch language half way, made
of stretches of ``CHAIN`` words of two documents. Forward-backward gives every word's probabilities; a
document's language is the one with the largest sum over its words with letters, its score the mean.

Training looks at a bounded sample: the ``SAMPLE`` different stretches of least hash per language, or all if
there are fewer, of all stretches of all whole training texts. A stretch that comes again counts once. The model is two tables of fixed size. Prediction handles all
documents of a batch at once: stretches of ``CHAIN`` words pass their transfer matrices on, so the exact
chain over a whole text costs one pass over positions of a stretch, whatever the text's length.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and if there is nothing to
learn from; ties go to the first language in code-point order; repeated rows are predicted alike; rows without
a language are predicted and not learned from; a null doc_id is not held out; an empty table gives an empty
result; extra columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.pretokens import Recent
from tonetape.llm.shared import column, documents, short_batches, stored

FEATURES = 1 << 16
LEXICON = 1 << 15
#: Letters of a word that the lexicon counts at most: function words are short.
LEXICON_LETTERS = 8
CHAIN = 64
#: Different stretches per language that training looks at, at most.
SAMPLE = 3000
EPOCHS = 4
BATCH = 64
RATE = 0.2
UNKNOWN = "und"


def hashed_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of runs of 1 to 3 letters and of affixes, by word."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, found, run = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        m = len(codes) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        good = owner[:m] == owner[n - 1 :]
        if n == 1:
            good &= codes > 3
        if n == 4:  # the longest are affixes
            good &= (codes[:m] == 2) | (codes[n - 1 :] == 3)
        at = np.flatnonzero(good)
        mixed = (run[at] ^ (run[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[at])
        found.append(((mixed >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found)


def letters_of(word: bytes) -> str:
    """The word in lower case from its first to its last letter; empty if it has none."""
    text = word.decode().lower()
    if text.isalpha():
        return text
    places = [i for i, c in enumerate(text) if c.isalpha()]
    return text[places[0] : places[-1] + 1] if places else ""


def lexicon_cell(word: str) -> int:
    """The lexicon's cell of a word, -1 if it isn't counted."""
    return xxhash.xxh32_intdigest(word) % LEXICON if 0 < len(word) <= LEXICON_LETTERS else -1


def forward_backward(unary: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chains, length, labels) and expected steps (labels, labels) of chains of one length."""
    n, length, labels = unary.shape
    local = np.exp(unary - unary.max(axis=2, keepdims=True))
    moves = np.exp(steps)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ moves) * local[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * local[:, t + 1]) @ moves.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pairs = alpha[:, :-1, :, None] * moves * (beta[:, 1:] * local[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return post, pairs.sum(axis=(0, 1))


@dataclass
class Model:
    """Weights of a trained chain; ``languages`` in code-point order."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weight: float
    steps: np.ndarray
    cache: Recent | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "cache"} | {"cache": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels) scores of words of letters."""
        owner, found = hashed_ngrams(words)
        out = np.stack([np.bincount(owner, self.weights[found, k], len(words)) for k in range(len(self.languages))], axis=1)
        cells = np.fromiter(map(lexicon_cell, words), np.int64, len(words))
        out[cells >= 0] += self.lexicon_weight * self.lexicon[cells[cells >= 0]]
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Scores of each word and whether it has letters, as 32-bit floats."""
        texts = [letters_of(w) for w in words]
        table = np.zeros((len(words), len(self.languages) + 1), "<f4")
        some = [i for i, t in enumerate(texts) if t]
        if some:
            table[some, :-1] = self.scores([texts[i] for i in some])
            table[some, -1] = 1
        raw, width = table.tobytes(), 4 * table.shape[1]
        return [raw[i : i + width] for i in range(0, len(raw), width)]

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of all texts: probabilities (words, labels), whether it has letters, and words per text."""
        if self.cache is None:
            self.cache = Recent(self._of_words)
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(self.cache.values([w for ws in words for w in ws])), "<f4")
        table = flat.reshape(-1, len(self.languages) + 1)
        unary, lettered = table[:, :-1].astype(np.float64), table[:, -1] > 0
        return chain_posteriors(unary, sizes, self.steps), lettered, sizes


def chain_posteriors(unary: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Exact posteriors of chains of any length, laid end to end.

    Chains are cut into stretches. Products of a stretch's transfer matrices carry the forward and backward
    vectors from stretch to stretch; then every stretch is run with the vectors that reach it.
    """
    total, labels = unary.shape
    if not total:
        return unary
    counts = -(-sizes // CHAIN)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * CHAIN
    length = np.minimum(CHAIN, np.repeat(sizes, counts) - number * CHAIN)
    order = np.argsort(-length, kind="stable")  # at place t the stretches that reach it come first
    start, length, place = start[order], length[order], np.argsort(order)
    live = [int((length > t).sum()) for t in range(int(length.max()))]
    local = np.exp(unary - unary.max(axis=1, keepdims=True))
    moves = np.exp(steps - steps.max())
    n = len(start)
    # Transfer matrices: row i is the forward vector that starts from label i before the stretch.
    transfer = np.tile(np.eye(labels), (n, 1, 1))
    for t, m in enumerate(live):
        step = (transfer[:m] @ moves) * local[start[:m] + t][:, None, :]
        transfer[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    into = np.empty((n, labels))  # forward vector before each stretch
    out_of = np.empty((n, labels))  # backward vector behind it
    deepest = int(number.max())
    of_number = [np.flatnonzero(number == k) for k in range(deepest + 1)]
    uniform = np.linalg.solve(moves.T, np.ones(labels)) if np.linalg.cond(moves) < 1e12 else np.ones(labels)
    into[place[of_number[0]]] = uniform  # so that the first word has no step before it
    for k in range(1, deepest + 1):
        here, before = place[of_number[k]], place[of_number[k] - 1]
        vector = np.einsum("ni,nij->nj", into[before], transfer[before])
        into[here] = vector / np.abs(vector).sum(axis=1, keepdims=True)
    last = number == np.repeat(counts, counts) - 1
    out_of[place[last]] = 1.0
    for k in range(deepest, 0, -1):
        here, before = place[of_number[k]], place[of_number[k] - 1]
        vector = np.einsum("nij,nj->ni", transfer[here], out_of[here])
        out_of[before] = vector / vector.sum(axis=1, keepdims=True)
    forward = np.empty((total, labels))
    state = into.copy()
    for t, m in enumerate(live):
        at = start[:m] + t
        step = (state[:m] @ moves) * local[at]
        state[:m] = step / step.sum(axis=1, keepdims=True)
        forward[at] = state[:m]
    state = out_of.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        # Transfers begin with a step, so the vector behind a stretch already includes the next one's.
        forward[at] *= state[:m]
        step = (state[:m] * local[at]) @ moves.T
        state[:m] = step / step.sum(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


# --- Training -------------------------------------------------------------------------------------


def learnable(docs: DataFrame) -> Column:
    """Documents that may be learned from: crc32 of the id as text modulo 4 is not 2; the language is known."""
    return (~held_out(docs)) & column(docs, "lang").isNotNull() & column(docs, "text").isNotNull()


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(column(docs, "doc_id").cast("string")) % 4 == 2, F.lit(False))


def gather(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, dict[str, list[str]]]:
    """Languages, lexicon counts (cells, languages) over all given documents, and sampled stretches per language.

    ``docs`` has text and lang. Two passes over the texts: tasks send sums per cell and language and their ``sample``
    least hashes of stretches; then the stretches up to the least ``sample`` hashes of all.
    """
    spark = docs.sparkSession
    short_batches(spark)
    languages = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return [], np.zeros((LEXICON, 0)), {}
    index = {name: i for i, name in enumerate(languages)}
    n = len(languages)

    def run(batches):
        counts = np.zeros((n, LEXICON), np.int64)
        least = [np.zeros(0, np.int64) for _ in languages]
        cells = Recent(lambda words: [lexicon_cell(letters_of(w)) for w in words])
        for batch in batches:
            words = [t.split() for t in batch.column(0).to_pylist()]
            owners = [index[x] for x in batch.column(1).to_pylist()]
            found = np.array(cells.values([w for ws in words for w in ws]), np.int64)
            labels = np.repeat(owners, [len(ws) for ws in words])
            good = found >= 0
            counts += np.bincount(labels[good] * LEXICON + found[good], minlength=n * LEXICON).reshape(n, LEXICON)
            hashes: list[list[int]] = [[] for _ in languages]
            for label, ws in zip(owners, words, strict=True):
                hashes[label] += [h for h, _ in _stretches(ws)]
            least = [np.unique(np.concatenate([x, np.array(y, np.int64)]))[:sample] for x, y in zip(least, hashes, strict=True)]
        for label in range(n):
            at = np.flatnonzero(counts[label])
            if len(at):
                yield _gathered(at, [label] * len(at), counts[label, at])
            if len(least[label]):
                yield _gathered([-1] * len(least[label]), [label] * len(least[label]), least[label])

    raw = docs.select(F.col("text").cast("binary").alias("text"), "lang")
    found = stored(raw.mapInArrow(run, "cell int, label int, n bigint"))
    lexicon = np.zeros((LEXICON, n))
    for batch in found.where("cell >= 0").groupBy("cell", "label").agg(F.sum("n").alias("n")).toArrow().to_batches():
        lexicon[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    hashes = stored(found.where("cell < 0").select("label", "n").distinct())
    # The least of each partition, then of all: no task holds more than that of a language.
    last = [max((r["n"] for r in hashes.where(F.col("label") == k).orderBy("n").limit(sample).collect()), default=-1) for k in range(n)]

    def draw(batches):
        for batch in batches:
            rows = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label = index[lang]
                rows |= {(label, h): stretch for h, stretch in _stretches(text.split()) if h <= last[label]}
            if rows:
                labels, keys = zip(*rows, strict=True)
                columns = [pa.array(labels, pa.int32()), pa.array(keys, pa.int64()), pa.array([x.decode() for x in rows.values()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "hash", "stretch"])

    drawn = raw.mapInArrow(draw, "label int, hash bigint, stretch string").groupBy("label", "hash").agg(F.min("stretch").alias("stretch"))
    stretches: dict[str, list[str]] = {name: [] for name in languages}
    for row in drawn.orderBy("label", "stretch").collect():
        stretches[languages[row["label"]]].append(row["stretch"])
    return languages, lexicon, stretches


def _stretches(words: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(63-bit hash, text) of each stretch of CHAIN words."""
    for i in range(0, len(words), CHAIN):
        stretch = b" ".join(words[i : i + CHAIN])
        yield xxhash.xxh64_intdigest(stretch) >> 1, stretch


def _gathered(cells, labels, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int32()), pa.array(labels, pa.int32()), pa.array(counts, pa.int64())], ["cell", "label", "n"]
    )


def fit(languages: list[str], counts: np.ndarray, stretches: dict[str, list[str]], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Train the chain by AdaGrad on its log-likelihood."""
    n = len(languages)
    smooth = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * LEXICON)) if n else counts
    lexicon = (smooth - smooth.mean(axis=1, keepdims=True)) if n else smooth
    model = Model(languages, np.zeros((FEATURES, n)), lexicon, 0.5, np.zeros((n, n)))
    chains = _switching(languages, stretches, seed)
    if n < 2 or not chains:
        return model
    grown = [np.full(model.weights.shape, 1e-6), 1e-6, np.full((n, n), 1e-6)]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(chains)), max(1, len(chains) // BATCH)):
            _learn(model, [chains[i] for i in part], grown)
    return model


def _switching(languages: list[str], stretches: dict[str, list[str]], seed: int) -> list[tuple[list[str], np.ndarray]]:
    """Chains of ``CHAIN`` words: half a stretch of one document, then half a stretch of another."""
    order = np.random.default_rng(seed)
    halves = []
    for label, name in enumerate(languages):
        for stretch in stretches[name]:
            words = [w for w in map(letters_of, stretch.encode().split()) if w]
            halves += [(label, words[i : i + CHAIN // 2]) for i in range(0, len(words), CHAIN // 2) if words[i : i + CHAIN // 2]]
    out = []
    pairs = order.permutation(len(halves))
    for i in range(0, len(pairs) - 1, 2):
        (x, first), (y, second) = halves[pairs[i]], halves[pairs[i + 1]]
        out.append((first + second, np.array([x] * len(first) + [y] * len(second))))
    return out


def _learn(model: Model, chains: list[tuple[list[str], np.ndarray]], grown: list) -> None:
    n, length = len(model.languages), max(len(ws) for ws, _ in chains)
    words = [w for ws, _ in chains for w in ws]
    owner, found = hashed_ngrams(words)
    cells = np.fromiter(map(lexicon_cell, words), np.int64, len(words))
    known = np.where((cells >= 0)[:, None], model.lexicon[cells], 0.0)
    flat = np.stack([np.bincount(owner, model.weights[found, k], len(words)) for k in range(n)], axis=1) + model.lexicon_weight * known
    grad_words, grad_steps, at = np.zeros_like(flat), np.zeros((n, n)), 0
    by_size: dict[int, list[int]] = {}
    begins = []
    for i, (ws, _) in enumerate(chains):
        begins.append(at)
        at += len(ws)
        by_size.setdefault(len(ws), []).append(i)
    del length
    for size, members in by_size.items():
        places = np.array([begins[i] for i in members])[:, None] + np.arange(size)
        truth = np.stack([chains[i][1] for i in members])
        post, pairs = forward_backward(flat[places], model.steps)
        target = np.eye(n)[truth]
        grad_words[places] = target - post
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        grad_steps += seen - pairs
    grad = np.stack([np.bincount(found, grad_words[owner, k], FEATURES) for k in range(n)], axis=1)
    scale = 1.0 / len(chains)
    grads = [grad * scale, float((grad_words * known).sum()) * scale, grad_steps * scale]
    for k, g in enumerate(grads):
        grown[k] = grown[k] + g * g
    model.weights += RATE * grads[0] / np.sqrt(grown[0])
    model.lexicon_weight += RATE * grads[1] / np.sqrt(grown[1])
    model.steps += RATE * grads[2] / np.sqrt(grown[2])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from the text and language of the documents that may be learned from."""
    rows = docs.where(learnable(docs)).select(column(docs, "text").alias("text"), column(docs, "lang").alias("lang"))
    return fit(*gather(rows, sample))


# --- Prediction -----------------------------------------------------------------------------------


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and ``spans``: (first word, words, language) of each run of one language."""
    short_batches(docs.sparkSession)
    frame = docs.select(
        column(docs, "doc_id").alias("doc_id"),
        held_out(docs).alias("held_out"),
        F.coalesce(column(docs, "text"), F.lit("")).cast("binary").alias("text"),
    )
    span = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

    def run(batches):
        for batch in batches:
            rows = _predicted(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.list_(span)),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    kinds = "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"
    return frame.mapInArrow(run, kinds)


def _predicted(model: Model, texts: list[bytes]) -> list[tuple]:
    if not model.languages:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    post, lettered, sizes = model.posteriors(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(model.languages)
    sums = np.stack([np.bincount(owner[lettered], post[lettered, k], len(texts)) for k in range(n)], axis=1)
    counts = np.bincount(owner[lettered], minlength=len(texts))
    best, label = sums.argmax(axis=1), post.argmax(axis=1)
    breaks = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])) if len(label) else []
    spans: list[list[dict]] = [[] for _ in texts]
    begins = np.cumsum(sizes) - sizes
    for a, b in zip(breaks, [*breaks[1:], len(label)], strict=True):
        of = owner[a]
        spans[of].append({"start": int(a - begins[of]), "words": int(b - a), "lang": model.languages[label[a]]})
    out = []
    for i in range(len(texts)):
        if counts[i]:
            out.append((model.languages[best[i]], min(1.0, max(0.0, float(sums[i, best[i]] / counts[i]))), spans[i]))
        else:
            out.append((UNKNOWN, 0.0, []))
    return out


def op8_language(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return predict(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
