"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are its own log odds and the greatest log odds of its character strings of several lengths.  The
network is trained on the highest window of each text, with log odds learned from the half of the training texts that the
text is not in.  A text's score is that of its highest window; windows of `SPAN` words start every `STEP` words, so all words
are read, most of them twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, with_columns
from lodestone.llm.quality import held_out
from lodestone.llm.shingles import mix, words

#: Words per window and between window starts; hidden units; lengths of character strings (bytes); bits of their tables.
SPAN, STEP, HIDDEN, GRAMS, BITS = 32, 16, 8, (4, 6, 8), 18
#: Labelled rows to learn from, per class (those with the smallest hash); passes.
TOXIC, CLEAN, PASSES = 2_000, 6_000, 40
#: Windows of a training text that compete to be its highest, those with the strongest inputs.
TRIED = 6
#: Bytes of training texts tokenised at once, and words of them whose windows are laid out at once.
AT_ONCE, LAID = 1 << 20, 1 << 18
#: Pseudo-count of the log odds, and the score from which a text counts as toxic.
PRIOR, CUT = 4.0, 0.3

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FACTORS = np.random.default_rng(99).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct words of the texts as rows: (word of each place, hash bucket per distinct word, per length the buckets
    of its character strings as (row, bucket) pairs, words per text)."""
    from lodestone.llm.shingles import LOWER

    hashes, starts, ends, counts = words(texts, _BREAK)
    distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    data = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), np.uint8).astype(np.uint64)
    shift = np.uint64(64 - BITS)
    strings = []
    for n in GRAMS:
        room = np.maximum(ends[at] - starts[at] - n + 1, 0)
        row = np.repeat(np.arange(len(at)), room)
        place = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room) + starts[at][row]
        value = np.zeros(len(row), np.uint64)
        for j in range(n):
            value += data[place + j] * _FACTORS[j]
        strings.append(np.stack([row, (mix(value) >> shift).astype(np.int64)]))
    return inverse, (mix(distinct + np.uint64(5)) >> shift).astype(np.int64), strings, counts


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """As `tokens`, a few texts at a time: memory follows the words and the distinct words, not the working space."""
    known, parts, start = np.empty(0, np.uint64), [], 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size, end = size + len(texts[end]), end + 1
        inverse, word, strings, counts = tokens(texts[start:end])
        # A word is known by its bucket and those of its strings: equal inputs, so equal rows.
        key = mix(word.astype(np.uint64) + np.uint64(1))
        for j, (row, bucket) in enumerate(strings):
            np.add.at(key, row, mix(bucket.astype(np.uint64) + np.uint64((j + 1) << BITS)))
        new = np.flatnonzero(~np.isin(key, known))
        new = new[np.unique(key[new], return_index=True)[1]]
        known = np.concatenate([known, key[new]])
        place = np.full(len(word), -1)
        place[new] = np.arange(len(new))
        fresh = [np.stack([place[row], bucket])[:, place[row] >= 0].astype(np.int32) for row, bucket in strings]
        fresh = [f[:, np.argsort(f[0], kind="stable")] for f in fresh]
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], key)].astype(np.int32)
        parts.append((at[inverse], word[new], [f + np.array([[len(known) - len(new)], [0]], np.int32) for f in fresh], counts))
        start = end
    strings = [np.concatenate([p[2][j] for p in parts], axis=1) for j in range(len(GRAMS))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), strings, np.concatenate([p[3] for p in parts])


def presence(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Clean and toxic texts that hold a word or character-string bucket."""
    counts = np.zeros((1 + len(GRAMS), 2, 1 << BITS), np.float32)
    for text, y in zip(texts, toxic.astype(int)):
        _, word, strings, _ = tokens([text])
        for j, found in enumerate([word, *(s[1] for s in strings)]):
            counts[j, y, np.unique(found)] += 1
    return counts


class Odds:
    """Log odds of word and character-string buckets, from their `presence` in toxic and clean texts."""

    def __init__(self, counts: np.ndarray, toxic: np.ndarray):
        bad = max(1, int(toxic.sum()))
        share = bad / max(2, len(toxic))
        odds = np.log(counts[:, 1] + PRIOR * share) - np.log(counts[:, 0] + PRIOR * (1 - share)) - np.log(share / (1 - share))
        self.tables = np.clip(odds, -4, 8).astype(np.float32)
        self.tables[(counts.sum(axis=1)) == 0] = 0

    def inputs(self, word: np.ndarray, strings: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(word) + 1, 2 + len(GRAMS)), np.float32)  # the last row pads
        out[:-1, 0], out[:-1, 1] = 1, self.tables[0, word]
        for j, (row, bucket) in enumerate(strings):
            if len(row):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                out[row[first], 2 + j] = np.maximum.reduceat(self.tables[1 + j, bucket], first)
        return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of every window (-1 pads), and the text it is of; a text of few words is one window."""
    number = np.where(counts > 0, np.maximum(-(-(counts - SPAN) // STEP), 0) + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    order = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = np.cumsum(counts) - counts
    place = (first[text] + STEP * order)[:, None] + np.arange(SPAN)
    return np.where(place < (first + counts)[text][:, None], place, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """p: W, U, b per direction (gates: update, reset, candidate), attention A and v, output o and c."""

    def __init__(self, inputs: int, seed: int = 1):
        rng, h = np.random.default_rng(seed), HIDDEN
        w = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", 0.5 * w(inputs, 3 * h)), ("U", w(h, 3 * h)), ("b", np.zeros(3 * h, np.float32)))}
        self.p |= {"A": w(2 * h, h), "v": w(h), "o": w(2 * h), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: inputs' part of the gates (time, windows, 3 h) in reading order."""
        h, u = HIDDEN, self.p[f"U{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[t][:, None]
            new = state + m * z * (c - state)
            if keep is not None:
                keep.append((state, z, r, c, m))
            out[t] = state = new
        return out

    def logits(self, rows: np.ndarray, place: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """rows: inputs per distinct word (the last one pads); place: row of each word of each window."""
        mask = (place.T != len(rows) - 1).astype(np.float32)
        both = []
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            x = (rows @ self.p[f"W{d}"] + self.p[f"b{d}"])[place.T[order]]
            own = [] if keep is not None else None
            both.append(self._run(x, mask[order], d, own)[order])
            if keep is not None:
                keep[d] = own
        hidden = np.concatenate(both, axis=2)
        lift = np.tanh(hidden @ self.p["A"])
        energy = np.where(mask > 0, lift @ self.p["v"], -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * hidden).sum(axis=0)
        if keep is not None:
            keep |= {"hidden": hidden, "lift": lift, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradient(self, rows: np.ndarray, place: np.ndarray, y: np.ndarray, sample: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        logit = self.logits(rows, place, keep)
        dlogit = ((_sigmoid(logit) - y) * sample / len(y)).astype(np.float32)
        hidden, lift, weight, pooled = keep["hidden"], keep["lift"], keep["weight"], keep["pooled"]
        g = {"o": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * self.p["o"]
        dhidden = weight[:, :, None] * dpooled
        dweight = (hidden * dpooled).sum(axis=2)
        denergy = weight * (dweight - (weight * dweight).sum(axis=0))
        g["v"] = (lift * denergy[:, :, None]).sum(axis=(0, 1))
        dlift = denergy[:, :, None] * self.p["v"] * (1 - lift * lift)
        g["A"] = np.einsum("tbi,tbj->ij", hidden, dlift)
        dhidden = dhidden + dlift @ self.p["A"].T
        h = HIDDEN
        for d, order, part in (("f", slice(None), slice(0, h)), ("b", slice(None, None, -1), slice(h, 2 * h))):
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            du, dw, db = np.zeros_like(u), np.zeros_like(w), np.zeros_like(self.p[f"b{d}"])
            dstate = np.zeros_like(hidden[0, :, :h])
            dh, at = dhidden[order][:, :, part], place.T[order]
            for t in range(len(at) - 1, -1, -1):
                state, z, r, c, m = keep[d][t]
                dnew = dstate + dh[t]
                dz = dnew * m * (c - state) * z * (1 - z)
                dc = dnew * m * z * (1 - c * c)
                dstate = dnew * (1 - m * z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                dstate = dstate + drs * r
                gates = np.concatenate([dz, dr], axis=1)
                dstate = dstate + gates @ u[:, : 2 * h].T
                du[:, : 2 * h] += state.T @ gates
                du[:, 2 * h :] += (r * state).T @ dc
                every = np.concatenate([gates, dc], axis=1)
                dw += rows[at[t]].T @ every
                db += every.sum(axis=0)
            g |= {f"U{d}": du, f"W{d}": dw, f"b{d}": db}
        return g


class Model:
    def __init__(self, odds: Odds | None, network: Network | None, shift: float = 0.0):
        self.odds, self.network, self.shift = odds, network, shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 per text; 0 for a text without words."""
        out = np.full(len(texts), -np.inf)
        if self.network is None:
            return np.zeros(len(texts))
        inverse, word, strings, counts = tokens(texts)
        rows = self.odds.inputs(word, strings)
        place, text = windows(counts)
        ids = np.append(inverse, len(word))
        for at in range(0, len(place), 8192):
            np.maximum.at(out, text[at : at + 8192], self.network.logits(rows, ids[place[at : at + 8192]]))
        return np.round(_sigmoid(np.clip(out + self.shift, -500, 500)) * (counts > 0), 6)  # sums may differ in their last bits by batch


def _laid(counts: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of the texts as rows of their words, and their texts, some texts at a time; ids ends in the row that pads."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        before = ends[start] - counts[start]
        end = max(start + 1, int(np.searchsorted(ends, before + LAID, side="right")))
        place, text = windows(counts[start:end])
        yield ids[np.where(place < 0, len(ids) - 1, place + before)], text + start
        start = end


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """The network learns each half of the texts with log odds from the other half; the model gets those of all."""
    if not toxic.any() or toxic.all():
        return Model(None, None)
    half = np.zeros(len(texts), bool)
    for y in (False, True):
        half[np.flatnonzero(toxic == y)[::2]] = True
    held = [presence([t for t, h in zip(texts, half) if h == side], toxic[half == side]) for side in (False, True)]
    parts = [vocabulary([t for t, h in zip(texts, half) if h != side]) for side in (False, True)]
    inputs = [Odds(c, toxic[half == side]).inputs(p[1], p[2]) for c, side, p in zip(held, (False, True), parts)]
    rows = np.concatenate([inputs[0][:-1], inputs[1]])
    ids = np.concatenate([parts[0][0], parts[1][0] + np.int32(len(parts[0][1])), np.array([len(rows) - 1], np.int32)])
    counts = np.concatenate([p[3] for p in parts])
    del parts, inputs
    y = np.concatenate([toxic[half], toxic[~half]]).astype(np.float32)
    network = Network(2 + len(GRAMS))
    sample = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    power, best = rows[:, 1:].sum(axis=1), []
    for place, text in _laid(counts, ids):
        strength = power[place].max(axis=1)
        order = np.lexsort((-strength, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        order = order[rank < TRIED]
        best.append((place[order], text[order], strength[order]))
    place, text, strength = (np.concatenate([b[i] for b in best]) for i in range(3))
    for step in range(1, PASSES * 4 + 1):
        if step % 8 == 1:  # the highest window of each text, first by its strongest input
            value = strength if step == 1 else np.concatenate([network.logits(rows, place[a : a + 8192]) for a in range(0, len(place), 8192)])
            order = np.lexsort((-value, text))
            top = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))] if len(order) else order
        g = network.gradient(rows, place[top], y[text[top]], sample[text[top]])
        for k, (m, v) in moments.items():
            grad = g[k] + 1e-4 * network.p[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            network.p[k] = (network.p[k] - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    logit, bad = np.full(len(y), -30.0), y > 0
    for place, text in _laid(counts, ids):
        for at in range(0, len(place), 8192):
            np.maximum.at(logit, text[at : at + 8192], network.logits(rows, place[at : at + 8192]))
    cuts = np.unique(np.quantile(logit, np.linspace(0, 1, 400)))
    value = [(logit[bad] >= c).mean() - 3 * (logit[~bad] >= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(value) >= max(value) - 1e-12)
    return Model(Odds(held[0] + held[1], toxic), network, float(np.log(CUT / (1 - CUT)) - cuts[best[len(best) // 2]]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 4, fold: int = 2) -> Model:
    """Fitted on the driver, on `TOXIC` and `CLEAN` labelled texts at most, whole."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    by_hash = lambda y, n: known.where((F.col("_y") > 0) == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = F.broadcast(by_hash(True, TOXIC).union(by_hash(False, CLEAN)))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(chosen, "_id").select("_id", "_t", "_y")
    found = sorted((r["_id"], bytes(r["_t"]), r["_y"]) for r in rows.withColumn("_t", F.col("_t").cast("binary")).collect())
    return fit([r[1] for r in found], np.array([r[2] > 0 for r in found], bool))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `_score` (0 to 1, higher: more toxic; toxic from `CUT` on) of every whole text.

    Null and empty texts and texts without words score 0; repeated rows score the same; an empty table gives an
    empty one; without labels of both classes every score is 0.  Other columns pass through, whatever their names; one
    named `_score` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, text_col, "_score double", lambda texts: [pa.array(shared.value.score(texts))])
