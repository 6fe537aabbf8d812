"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its embedding (zero for words outside the vocabulary) beside a summary of its characters: a small
bidirectional gated recurrent network reads the characters, and attention pools its states. A second network of the same
form reads windows of ``WINDOW`` words that overlap by half; its pooled states give the window's logit. A text's score is
that of its worst window, in training as in scoring, so a short insult in a long text counts as much as in a short one.

The network is trained inside one Spark task on a bounded sample of labelled texts; its gradients are written out below.
Scoring runs everywhere: the character network once per distinct word of a slice, the word network over all windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import ALPHANUMERIC, U64, find_words, settled, span_hashes, text_slices

FIT_ROWS = 3000  # labelled texts used for fitting, at most about; a third of them toxic if there are enough
WINDOW, STRIDE = 48, 24  # words of a window, words between two windows
LONGEST = 24  # characters of a word; longer words are read as several
VOCABULARY = 20_000  # words with an embedding
SEEN_IN = 3  # texts that must hold such a word
CHARACTERS = 509  # rows of the character table; code points share them by remainder
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.01, 11
THRESHOLD = 0.7
_TOGETHER = 1024  # sequences run side by side
_F = np.float32

Weights = dict[str, np.ndarray]


def is_held_out(doc_id: Column) -> Column:
    """Whether ``crc32(doc_id as text) mod 3`` is 1; a null id is not held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


# the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_encoder(name: str, inputs: int, hidden: int, attention: int, draw: np.random.Generator) -> Weights:
    """Weights of one bidirectional network with attention pooling."""

    def matrix(rows: int, columns: int) -> np.ndarray:
        return (draw.standard_normal((rows, columns)) / np.sqrt(rows)).astype(_F)

    out = {f"{name}.attend": matrix(2 * hidden, attention), f"{name}.shift": np.zeros(attention, _F), f"{name}.pick": matrix(attention, 1)[:, 0]}
    for way in ("on", "back"):
        out[f"{name}.{way}.in"] = matrix(inputs, 3 * hidden)
        out[f"{name}.{way}.bias"] = np.zeros(3 * hidden, _F)
        out[f"{name}.{way}.state"] = matrix(hidden, 3 * hidden)
    return out


def new_network(words: int, seed: int = SEED, word_size: int = 8, character_size: int = 8, character_hidden: int = 8, hidden: int = 16, attention: int = 8) -> Weights:
    draw = np.random.default_rng(seed)
    return {
        "word": np.concatenate([np.zeros((1, word_size)), draw.standard_normal((words, word_size)) * 0.3]).astype(_F),
        "character": (draw.standard_normal((CHARACTERS, character_size)) * 0.5).astype(_F),
        **new_encoder("spelling", character_size, character_hidden, attention, draw),
        **new_encoder("window", word_size + 2 * character_hidden, hidden, attention, draw),
        "out": (draw.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(_F),
        "out.bias": np.zeros(1, _F),
    }


def _run(inputs: np.ndarray, mask: np.ndarray, state: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction over projected ``inputs`` (time, sequence, 3 x hidden); masked steps keep the state."""
    steps, width, hidden = len(inputs), inputs.shape[1], state.shape[0]
    h = np.zeros((width, hidden), inputs.dtype)
    out = np.empty((steps, width, hidden), inputs.dtype)
    for t in range(steps):
        g = h @ state
        gates = _sigmoid(inputs[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        reset, update = gates[:, :hidden], gates[:, hidden:]
        fresh = np.tanh(inputs[t, :, 2 * hidden :] + reset * g[:, 2 * hidden :])
        if keep is not None:
            keep.append((h, reset, update, fresh, g[:, 2 * hidden :]))
        step = (1 - update) * (fresh - h)
        step *= mask[t][:, None]
        h = h + step
        out[t] = h
    return out


def _run_gradient(d_out: np.ndarray, mask: np.ndarray, state: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``state``."""
    steps, width, hidden = d_out.shape
    d_inputs, d_state = np.empty((steps, width, 3 * hidden), d_out.dtype), np.zeros_like(state)
    d_h = np.zeros((width, hidden), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, reset, update, fresh, g_fresh = kept[t]
        d_h = d_h + d_out[t]
        d_new = d_h * mask[t][:, None]
        d_before = d_h - d_new + d_new * update
        a_fresh = d_new * (1 - update) * (1 - fresh * fresh)
        a_update = d_new * (h - fresh) * update * (1 - update)
        a_reset = a_fresh * g_fresh * reset * (1 - reset)
        d_inputs[t] = np.concatenate([a_reset, a_update, a_fresh], 1)
        d_g = np.concatenate([a_reset, a_update, a_fresh * reset], 1)
        d_state += h.T @ d_g
        d_h = d_before + d_g @ state.T
    return d_inputs, d_state


def encode(net: Weights, name: str, projected: tuple[np.ndarray, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Pooled states (sequence, 2 x hidden) of sequences whose inputs are projected for both directions.

    ``mask`` (time, sequence) is 1 where a sequence has a step; every sequence has one at least.
    """
    on_kept, back_kept = ([], []) if keep is not None else (None, None)
    on = _run(projected[0], mask, net[f"{name}.on.state"], on_kept)
    back = _run(projected[1][::-1], mask[::-1], net[f"{name}.back.state"], back_kept)[::-1]
    states = np.concatenate([on, back], 2)
    looked = np.tanh(states @ net[f"{name}.attend"] + net[f"{name}.shift"])
    weight = np.where(mask > 0, looked @ net[f"{name}.pick"], _F(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep is not None:
        keep.update(on=on_kept, back=back_kept, states=states, looked=looked, weight=weight, pooled=pooled, mask=mask)
    return pooled


def encode_gradient(net: Weights, name: str, d_pooled: np.ndarray, kept: dict, grads: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Add the weights' gradients to ``grads``; return those of both projections."""
    states, looked, weight, mask = kept["states"], kept["looked"], kept["weight"], kept["mask"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = weight * (np.einsum("tbh,bh->tb", states, d_pooled) - (kept["pooled"] * d_pooled).sum(1))
    grads[f"{name}.pick"] += np.einsum("tb,tba->a", d_weight, looked)
    d_looked = d_weight[:, :, None] * net[f"{name}.pick"] * (1 - looked * looked)
    grads[f"{name}.attend"] += np.einsum("tbh,tba->ha", states, d_looked, optimize=True)
    grads[f"{name}.shift"] += d_looked.sum((0, 1))
    d_states += d_looked @ net[f"{name}.attend"].T
    hidden = states.shape[2] // 2
    d_on, d_state = _run_gradient(d_states[:, :, :hidden], mask, net[f"{name}.on.state"], kept["on"])
    grads[f"{name}.on.state"] += d_state
    d_back, d_state = _run_gradient(d_states[::-1, :, hidden:], mask[::-1], net[f"{name}.back.state"], kept["back"])
    grads[f"{name}.back.state"] += d_state
    return d_on, d_back[::-1]


def project(net: Weights, name: str, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(inputs @ net[f"{name}.{way}.in"] + net[f"{name}.{way}.bias"] for way in ("on", "back"))


def _project_gradient(net: Weights, name: str, inputs: np.ndarray, d_both: tuple[np.ndarray, np.ndarray], grads: Weights) -> np.ndarray:
    d_inputs = np.zeros_like(inputs)
    for way, d in zip(("on", "back"), d_both):
        grads[f"{name}.{way}.in"] += inputs.T @ d
        grads[f"{name}.{way}.bias"] += d.sum(0)
        d_inputs += d @ net[f"{name}.{way}.in"].T
    return d_inputs


# words of texts


class Tokens:
    """Distinct words of some texts with their characters, and per word of the texts its number among them."""

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        found = find_words(data, borders, ALPHANUMERIC)
        row, start, stop, hashes = found
        lead = (data & 0xC0) != 0x80  # first bytes of characters
        place = np.cumsum(lead, dtype=np.int64) - 1
        place = np.append(place, int(lead.sum()))
        first_byte = np.flatnonzero(lead)
        size = place[stop] - place[start]
        if len(size) and size.max() > LONGEST:
            pieces = -(-size // LONGEST)
            word = np.repeat(np.arange(len(size)), pieces)
            at = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = place[start][word] + at * LONGEST
            end = np.minimum(begin + LONGEST, place[stop][word])
            row, start = row[word], first_byte[begin]
            stop = np.append(first_byte, len(data))[end]
            size = end - begin
            hashes = span_hashes(data, start, stop)
        self.row = row
        self.hashes, sample, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.sizes = size[sample]
        points = _points(data)
        steps = np.arange(LONGEST)
        inside = steps[:, None] < self.sizes
        at = np.where(inside, place[start[sample]] + steps[:, None], 0)
        self.characters = (points[at] % CHARACTERS if len(points) else at).astype(np.int16)  # time, word
        self.mask = inside.astype(_F)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, A-Z as a-z."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)


def spell(net: Weights, tokens: Tokens) -> np.ndarray:
    """Character summary of every distinct word."""
    out = np.empty((len(tokens.sizes), 2 * len(net["spelling.on.state"])), _F)
    table = project(net, "spelling", net["character"])
    order = np.argsort(tokens.sizes, kind="stable")
    for at in range(0, len(order), _TOGETHER):
        some = order[at : at + _TOGETHER]
        longest = int(tokens.sizes[some].max())
        characters = tokens.characters[:longest, some]
        out[some] = encode(net, "spelling", tuple(t[characters] for t in table), tokens.mask[:longest, some])
    return out


def _inputs(net: Weights, vocabulary: np.ndarray, tokens: Tokens, spelled: np.ndarray) -> np.ndarray:
    return np.concatenate([net["word"][_word_rows(vocabulary, tokens.hashes)], spelled], 1)


def _word_rows(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def windows_of(row: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first word, words)`` of every window: a text's last one ends with the text."""
    count = np.bincount(row, minlength=texts)
    begin = np.cumsum(count) - count
    many = np.where(count > 0, np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(texts), many)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, begin[text] + at, np.minimum(count[text] - at, WINDOW)


def _steps(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(int(size.max()))[:, None]
    inside = steps < size
    return np.where(inside, first + steps, first), inside.astype(_F)


def window_logits(net: Weights, number: np.ndarray, table: tuple[np.ndarray, np.ndarray], first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), _F)
    for at in range(0, len(first), _TOGETHER):
        place, mask = _steps(first[at : at + _TOGETHER], size[at : at + _TOGETHER])
        words = number[place]
        pooled = encode(net, "window", tuple(t[words] for t in table), mask)
        out[at : at + _TOGETHER] = pooled @ net["out"] + net["out.bias"]
    return out


# training


def loss_and_gradients(net: Weights, vocabulary: np.ndarray, tokens: Tokens, first: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean logistic loss of some windows, and its gradients."""
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    place, mask = _steps(first, size)
    used, words = np.unique(tokens.number[place], return_inverse=True)
    words = words.reshape(place.shape)
    longest = int(tokens.sizes[used].max())
    characters, spelled_mask = tokens.characters[:longest, used], tokens.mask[:longest, used]
    table = project(net, "spelling", net["character"])
    kept_spelling: dict = {}
    spelled = encode(net, "spelling", tuple(t[characters] for t in table), spelled_mask, kept_spelling)
    rows = _word_rows(vocabulary, tokens.hashes[used])
    inputs = np.concatenate([net["word"][rows], spelled], 1)
    kept: dict = {}
    pooled = encode(net, "window", tuple(t[words] for t in project(net, "window", inputs)), mask, kept)
    logit = pooled @ net["out"] + net["out.bias"]
    loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
    d_logit = (_sigmoid(logit) - label) / len(label)
    grads["out"] += pooled.T @ d_logit
    grads["out.bias"] += d_logit.sum()
    d_both = encode_gradient(net, "window", d_logit[:, None] * net["out"], kept, grads)
    d_inputs = _project_gradient(net, "window", inputs, tuple(_gathered(d, words, len(used)) for d in d_both), grads)
    size_of_word = net["word"].shape[1]
    np.add.at(grads["word"], rows, d_inputs[:, :size_of_word])
    grads["word"][0] = 0  # words outside the vocabulary have no embedding
    d_both = encode_gradient(net, "spelling", d_inputs[:, size_of_word:], kept_spelling, grads)
    grads["character"] += _project_gradient(net, "spelling", net["character"], tuple(_gathered(d, characters, CHARACTERS) for d in d_both), grads)
    return loss, grads


def _gathered(d: np.ndarray, index: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the gradients of the places that took the same row."""
    flat, index = d.reshape(-1, d.shape[-1]), index.ravel().astype(np.int64)
    order = np.argsort(index, kind="stable")
    some, first = np.unique(index[order], return_index=True)
    out = np.zeros((rows, d.shape[-1]), d.dtype)
    if len(some):
        out[some] = np.add.reduceat(flat[order], first)
    return out


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> tuple[Weights, np.ndarray]:
    """Network and vocabulary (sorted word hashes) from labelled texts.

    The first round takes two windows of every text at random, the others its worst window under the network so far and,
    of texts that are not toxic, another one at random.
    """
    draw = np.random.default_rng(seed)
    label = np.array(labels, _F)
    parts = []
    seen: list[np.ndarray] = []
    for at in range(0, len(texts), BATCH):
        for low, high, data, borders in text_slices(pa.array(texts[at : at + BATCH], pa.large_string())):
            tokens = Tokens(data, borders)
            if len(tokens.row):
                parts.append((tokens, label[at + low : at + high], *windows_of(tokens.row, high - low)))
                pair = np.unique(np.stack([tokens.row, tokens.number]), axis=1)
                seen.append(tokens.hashes[pair[1]])
    hashes, count = np.unique(np.concatenate(seen) if seen else np.empty(0, U64), return_counts=True)
    known = count >= SEEN_IN
    hashes, count = hashes[known], count[known]
    vocabulary = np.sort(hashes[np.argsort(-count, kind="stable")[:VOCABULARY]])
    net = new_network(len(vocabulary), seed)
    mean, spread = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for part in draw.permutation(len(parts)):
            tokens, own, text, first, size = parts[part]
            some = np.flatnonzero(np.bincount(text, minlength=len(own)))
            begin = np.searchsorted(text, some)
            many = np.searchsorted(text, some, "right") - begin
            at_random = begin + (draw.random(len(some)) * many).astype(np.int64)
            if epoch:
                table = project(net, "window", _inputs(net, vocabulary, tokens, spell(net, tokens)))
                logits = window_logits(net, tokens.number, table, first, size)
                order = np.lexsort((-logits, text))
                worst = order[begin]
                chosen = np.concatenate([worst, at_random[own[some] == 0]])
            else:
                chosen = np.concatenate([at_random, begin + (draw.random(len(some)) * many).astype(np.int64)])
            _, grads = loss_and_gradients(net, vocabulary, tokens, first[chosen], size[chosen], own[text[chosen]])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / (epochs * len(parts))))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():  # Adam with clipped gradients
                g = g / max(norm, 1.0)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                spread[k] = 0.99 * spread[k] + 0.01 * g * g
                net[k] = (net[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-7)).astype(_F)
    return net, vocabulary


# the operator


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> bytes | None:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, or None without texts of both labels.

    Labels other than 0 and 1, rows without an id and documents without a text teach nothing; an id with several labels is
    toxic if one of them says so, one with several texts has the smallest. A third of about ``fit_rows`` ids is
    toxic and the rest not, both drawn by a hash, so the sample is small enough to be looked for in every partition. The training runs in one task.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = settled(known, "labels")
    count = dict(known.groupBy("toxic").count().collect())  # two rows
    if len(count) < 2:
        return None
    limits = {1: min(fit_rows / 3 / count[1], 1.0), 0: min(fit_rows * 2 / 3 / count[0], 1.0)}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity sample")), 11).cast("double") / float(1 << 53)
    drawn = known.where(draw < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0]))
    texts = docs.select("doc_id", F.make_valid_utf8("text").alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy(F.col("doc_id").alias("place"), "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [r for batch in batches for r in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
        some.sort()  # one order whatever the tasks before did
        if len({r[2] for r in some}) < 2:
            return
        order = np.random.default_rng(SEED).permutation(len(some))
        model = train([some[i][1] for i in order], [some[i][2] for i in order], epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    trained = settled(sample.repartition(1).mapInArrow(run, "model binary"), "toxicity-model").first()
    return None if trained is None else trained["model"]


def score(docs: DataFrame, model: bytes | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``, ``predicted`` (1 from 0.7) and ``n_windows``.

    Texts that are null or without a word have no window and score 0, as do all texts where the model is None. Words of
    more than 24 characters are read as several. Columns with one of the new names are replaced; repeated rows are scored
    one by one; an empty table stays empty.
    """
    new = ("score", "predicted", "n_windows")
    keep = [c for c in keep if c not in new]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("bigint").alias("n_windows"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocabulary = pickle.loads(shared.value)
        for batch in batches:
            for low, high, data, borders in text_slices(batch.column("text")):
                out, many = np.zeros(high - low), np.zeros(high - low, np.int64)
                tokens = Tokens(data, borders)
                text, first, size = windows_of(tokens.row, high - low)
                if len(text):
                    table = project(net, "window", _inputs(net, vocabulary, tokens, spell(net, tokens)))
                    logits = window_logits(net, tokens.number, table, first, size)
                    some, at, many_of = np.unique(text, return_index=True, return_counts=True)
                    out[some] = _sigmoid(np.maximum.reduceat(logits, at).astype(np.float64))
                    many[some] = many_of
                part = batch.slice(low, high - low)
                columns = [*[part.column(c) for c in names], pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32)), pa.array(many)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    types = dict(docs.dtypes)
    fields = ", ".join([*[f"{n} {types[c]}" for n, c in zip(names, keep)], "score double, predicted int, n_windows bigint"])
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    scored = plain.mapInArrow(run, fields)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *new)
