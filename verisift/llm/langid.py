"""Language of texts by a bidirectional gated recurrent network over bytes, trained here by backpropagation in time.

Texts are read in windows of bytes that cover all of them. Two recurrences, one from either end of a window, give every
position a state; a linear layer labels the position, and the probabilities of all positions that belong to letters are
averaged over the document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Rows of all languages together that the network is fitted on, at most; chosen by a hash of the id.
MAX_FIT_ROWS = 6_000
UNITS, TRAIN_WINDOW, WINDOW, BATCH = 8, 64, 128, 4096
STEPS, TRAIN_BATCH, RATE = 240, 192, 0.02
PAD = 256
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters: ASCII letters and all parts of longer characters.
_IN_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


class Recurrence:
    """One direction: an input table over bytes and the recurrent weights of update, reset and candidate."""

    def __init__(self, table: np.ndarray, gates: np.ndarray, candidate: np.ndarray) -> None:
        self.table, self.gates, self.candidate = table, gates, candidate

    @classmethod
    def new(cls, rng: np.random.Generator) -> Recurrence:
        table = (rng.normal(size=(PAD + 1, 3 * UNITS)) * 0.3).astype(np.float32)
        # The update gate is shut at the padding, so a state passes over it as it is.
        table[PAD] = 0
        table[PAD, :UNITS] = -30
        scale = 1 / np.sqrt(UNITS)
        gates = (rng.normal(size=(UNITS, 2 * UNITS)) * scale).astype(np.float32)
        return cls(table, gates, (rng.normal(size=(UNITS, UNITS)) * scale).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.candidate]

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the steps ``x`` (steps, windows), and with ``keep`` what the way back needs."""
        h = np.zeros((x.shape[1], UNITS), dtype=np.float32)
        out, kept = np.empty((*x.shape, UNITS), dtype=np.float32), []
        half = np.float32(0.5)
        for t in range(len(x)):
            into = self.table[x[t]]
            gate = h @ self.gates
            gate += into[:, : 2 * UNITS]
            gate *= half
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            update, reset = gate[:, :UNITS], gate[:, UNITS:]
            open_ = reset * h
            new = open_ @ self.candidate
            new += into[:, 2 * UNITS :]
            np.tanh(new, out=new)
            if keep:
                kept.append((h, update, reset, open_, new))
            h = h + update * (new - h)
            out[t] = h
        return out, kept

    def gradients(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the gradients ``d_out`` at the states."""
        d_gates, d_candidate = np.zeros_like(self.gates), np.zeros_like(self.candidate)
        d_into = np.empty((*x.shape, 3 * UNITS), dtype=np.float32)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, update, reset, open_, new = kept[t]
            d_h = d_h + d_out[t]
            d_new = d_h * update * (1 - new * new)
            d_open = d_new @ self.candidate.T
            d_candidate += open_.T @ d_new
            d_update = d_h * (new - h) * update * (1 - update)
            d_reset = d_open * h * reset * (1 - reset)
            d_gate = np.concatenate([d_update, d_reset], axis=1)
            d_gates += h.T @ d_gate
            d_into[t] = np.concatenate([d_gate, d_new], axis=1)
            d_h = d_h * (1 - update) + d_open * reset + d_gate @ self.gates.T
        flat, order = d_into.reshape(-1, 3 * UNITS), np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        d_table = np.zeros_like(self.table)
        d_table[seen] = np.add.reduceat(flat[order], first)
        d_table[PAD] = 0
        return [d_table, d_gates, d_candidate]


class LanguageNetwork:
    """Both recurrences and the output layer over ``languages``."""

    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = Recurrence.new(rng), Recurrence.new(rng)
        self.out = (rng.normal(size=(2 * UNITS, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.forth.parameters(), *self.back.parameters(), self.out, self.bias]

    @classmethod
    def of(cls, languages: list[str], parameters: list[np.ndarray]) -> LanguageNetwork:
        """The network with ``parameters`` in the order of that method."""
        network = object.__new__(cls)
        network.languages = languages
        network.forth, network.back = Recurrence(*parameters[:3]), Recurrence(*parameters[3:6])
        network.out, network.bias = parameters[6:]
        return network

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, windows, languages) for windows ``x`` of byte values or PAD."""
        forth, _ = self.forth.states(x)
        back, _ = self.back.states(x[::-1])
        logits = forth @ self.out[:UNITS] + back[::-1] @ self.out[UNITS:] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def train(self, windows: list[bytes], labels: np.ndarray, seed: int = 4) -> None:
        """Cross-entropy at every position of a letter, by Adam over batches balanced between the languages."""
        rng = np.random.default_rng(seed)
        x_all = windows_of(windows, TRAIN_WINDOW)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        each = max(1, TRAIN_BATCH // len(self.languages))
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(own, each) for own in by_label])
            x, y = x_all[:, rows], labels[rows]
            grads = self._gradients(x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
            for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        forth, kept_forth = self.forth.states(x, keep=True)
        back, kept_back = self.back.states(x[::-1], keep=True)
        states = np.concatenate([forth, back[::-1]], axis=2)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        counts = _IN_LETTER[x]
        p[:, np.arange(len(y)), y] -= 1
        p *= (counts / max(1, counts.sum()))[:, :, None].astype(np.float32)
        d_states = p @ self.out.T
        d_out = states.reshape(-1, 2 * UNITS).T @ p.reshape(-1, p.shape[2])
        return [
            *self.forth.gradients(x, kept_forth, d_states[:, :, :UNITS]),
            *self.back.gradients(x[::-1], kept_back, d_states[::-1, :, UNITS:]),
            d_out,
            p.sum(axis=(0, 1)),
        ]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and pooled probability of each text, ``und`` and 0 where there is no letter or no language."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        raw = [t.encode("utf-8", "surrogatepass") if t and _LETTER.search(t) else b"" for t in texts]
        pooled = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        cuts = [(i, b[at : at + WINDOW]) for i, b in enumerate(raw) for at in range(0, len(b), WINDOW)]
        # Windows of like length go together, so that little of a batch is padding.
        cuts.sort(key=lambda cut: len(cut[1]))
        for at in range(0, len(cuts), BATCH):
            part = cuts[at : at + BATCH]
            x = windows_of([w for _, w in part], len(part[-1][1]))
            counts = _IN_LETTER[x]
            owner = np.array([i for i, _ in part])
            np.add.at(pooled, owner, np.einsum("tbk,tb->bk", self.position_probabilities(x), counts, optimize=True))
            np.add.at(letters, owner, counts.sum(axis=0))
        out = []
        for i in range(len(texts)):
            if letters[i]:
                share = pooled[i] / letters[i]
                k = int(share.argmax())
                out.append((self.languages[k], float(min(1.0, share[k]))))
            else:
                out.append((UNDETERMINED, 0.0))
        return out


def windows_of(texts: list[bytes], length: int) -> np.ndarray:
    """(length, texts) of byte values, cut and padded at the end."""
    out = np.full((len(texts), length), PAD, dtype=np.int16)
    sizes = np.array([min(len(t), length) for t in texts])
    joined = np.frombuffer(b"".join(t[:length] for t in texts), dtype=np.uint8)
    out[np.arange(length) < sizes[:, None]] = joined
    return np.ascontiguousarray(out.T)


def fit(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str, text_col: str, lang_col: str) -> LanguageNetwork:
    """The network fitted on one window each of at most ``MAX_FIT_ROWS`` rows that have a language and are not held out."""
    known = docs.filter(
        F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull()
    ).filter(~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageNetwork([])
    share = MAX_FIT_ROWS / len(languages)
    part = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, 0.95 * share / counts[lang]))))
    place = F.pmod(F.xxhash64(id_col, F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    start = F.pmod(F.xxhash64(id_col, F.lit("window")), F.greatest(F.length(text_col) - TRAIN_WINDOW, F.lit(0)) + 1)
    sample = (
        known.filter(place < F.element_at(part, F.col(lang_col)))
        .select(
            F.col(lang_col).alias("lang"),
            F.substring(text_col, start.cast("int") + 1, F.lit(TRAIN_WINDOW)).alias("window"),
            F.col(id_col).cast("string").alias("id"),
        )
        .limit(MAX_FIT_ROWS)
        .toPandas()
        .sort_values(["id", "window"])
    )
    network = LanguageNetwork(sorted(sample["lang"].unique()))
    index = {lang: k for k, lang in enumerate(network.languages)}
    if network.languages:
        network.train([w.encode() for w in sample["window"]], np.array([index[lang] for lang in sample["lang"]]))
    return network


def identify_languages(
    docs: DataFrame,
    held_out: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    into: tuple[str, str] = ("lang_pred", "lang_score"),
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with the predicted language and its pooled probability, from whole texts alone.

    Languages are learned from rows of ``learn_from`` (else ``docs``) with a language whose id is not ``held_out``. A
    null text or one without letters is ``und`` with score 0, and so is every text if there is nothing to learn from.
    Equal texts get equal results. Other columns stay; columns of the two new names are replaced.
    """
    network = fit(learn_from if learn_from is not None else docs, held_out, id_col, text_col, lang_col)
    return label_languages(docs, network, text_col, into)


def label_languages(
    docs: DataFrame, network: LanguageNetwork, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "lang_score")
) -> DataFrame:
    """``docs`` with the language and its pooled probability that ``network`` gives, as ``identify_languages`` says."""
    # Plain arrays and names: a broadcast object would need this package on every executor.
    model = docs.sparkSession.sparkContext.broadcast((network.languages, network.parameters()))
    kept = [c for c in docs.columns if c not in into]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = LanguageNetwork.of(*model.value)
        for batch in slices(batches, text_col):
            found = shared.predict(batch.column(text_col).to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *into])

    fields = [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    return rows.mapInArrow(predict, T.StructType([*rows.schema.fields, *fields]))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has a letter, by the rule that the network's predictions go by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bool(t and _LETTER.search(t)) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
