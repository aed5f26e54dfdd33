"""Language identification by a bidirectional gated recurrent network over bytes.

Whole texts are cut into windows of WINDOW bytes. A gated recurrent unit reads
each window forwards, another backwards; every byte gets a distribution over
languages from both states, and a document's probabilities are the mean over
all its bytes. The network is trained in numpy by backpropagation through time
on a bounded sample of windows, and its few thousand weights go to the workers.

A unit's step, with E the embedding of the byte and s the logistic function:
z = s(E_z + U_z h), r = s(E_r + U_r h), n = tanh(E_n + r (U_n h + b)),
h' = (1 - z) n + z h.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches

WINDOW, HIDDEN, UNKNOWN = 64, 8, "und"
#: Training takes WINDOWS_PER_DOC evenly spread windows of at most FIT_DOCS documents, those with the smallest hash of their id.
FIT_DOCS, WINDOWS_PER_DOC = 3000, 6
#: Windows that run side by side.
CHUNK = 4096


@dataclass
class ByteRnn:
    langs: list[str]
    e: np.ndarray  # (2, 3h, 256) embeddings: rows of z, r, n
    u: np.ndarray  # (2, 3h, h)
    b: np.ndarray  # (2, h, 1)
    w: np.ndarray  # (L, 2h)
    c: np.ndarray  # (L, 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.u, self.b, self.w, self.c]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> ByteRnn:
    r = np.random.default_rng(seed)
    f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
    return ByteRnn(langs, f(2, 3 * hidden, 256, by=0.3), f(2, 3 * hidden, hidden, by=hidden**-0.5), np.zeros((2, hidden, 1), np.float32), f(len(langs), 2 * hidden, by=0.3), np.zeros((len(langs), 1), np.float32))


def _forward(m: ByteRnn, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: (T, B) bytes. States (2, T, h, B), the backward ones at their byte's place; keep: what the way back needs."""
    t_all, b = x.shape
    h = m.u.shape[2]
    states = np.empty((2, t_all, h, b), np.float32)
    kept: list = []
    half = np.ones((3 * h, 1), np.float32)
    half[: 2 * h] = 0.5  # s(v) = (1 + tanh(v / 2)) / 2
    for d in range(2):
        e, u = m.e[d] * half, m.u[d] * half
        state = np.zeros((h, b), np.float32)
        g, a = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        for t in range(t_all) if d == 0 else range(t_all - 1, -1, -1):
            np.take(e, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, state, out=a)
            gates = g[: 2 * h]
            gates += a[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r, n, hn = g[:h], g[h : 2 * h], g[2 * h :], a[2 * h :]
            hn += m.b[d]
            if keep:
                kept.append((d, t, z.copy(), r.copy(), hn.copy(), state))
            hn *= r
            n += hn
            np.tanh(n, out=n)
            new = states[d, t]
            np.subtract(state, n, out=new)
            new *= z
            new += n
            if keep:
                kept[-1] += (n.copy(),)
            state = new
    return states, kept


def _probabilities(m: ByteRnn, states: np.ndarray) -> np.ndarray:
    """(L, T, B)"""
    _, t, h, b = states.shape
    out = np.empty((len(m.langs), t, b), np.float32)
    for k in range(t):
        out[:, k] = m.w[:, :h] @ states[0, k] + m.w[:, h:] @ states[1, k]
    out += m.c[:, :, None]
    out -= out.max(0)
    np.exp(out, out=out)
    out /= out.sum(0)
    return out


def _gradients(m: ByteRnn, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes, and its gradients by backpropagation through time."""
    states, kept = _forward(m, x, keep=True)
    p = _probabilities(m, states)
    t_all, b = x.shape
    h = m.u.shape[2]
    loss = float(-np.log(np.maximum(p[y, :, np.arange(b)], 1e-9)).mean())
    p[y, :, np.arange(b)] -= 1
    p /= t_all * b
    ge, gu, gb, gw, gc = (np.zeros_like(a) for a in m.parameters())
    gc[:, 0] = p.sum((1, 2))
    one = [np.zeros((256, 3 * h), np.float32) for _ in range(2)]
    for d in range(2):
        for t in range(t_all):
            gw[:, d * h : (d + 1) * h] += p[:, t] @ states[d, t].T
    back = [np.zeros((h, b), np.float32) for _ in range(2)]
    for d, t, z, r, hn, before, n in reversed(kept):
        g = back[d] + m.w[:, d * h : (d + 1) * h].T @ p[:, t]
        gn = g * (1 - z) * (1 - n * n)
        gz = g * (before - n) * z * (1 - z)
        gr = gn * hn * r * (1 - r)
        into = np.concatenate([gz, gr, gn * r])  # of U h
        gu[d] += into @ before.T
        gb[d, :, 0] += (gn * r).sum(1)
        np.add.at(one[d], x[t], np.concatenate([gz, gr, gn]).T)
        back[d] = g * z + m.u[d].T @ into
    for d in range(2):
        ge[d] = one[d].T
    return loss, [ge, gu, gb, gw, gc]


def train(windows: np.ndarray, langs: list[str], steps: int = 240, batch: int = 256, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 1) -> ByteRnn:
    """windows: (N, WINDOW) bytes with their languages; each batch draws all languages alike. Adam with a falling rate."""
    names = sorted(set(langs))
    m, r = new_model(names, hidden, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(np.asarray(langs) == x) for x in names]
    first = [np.zeros_like(a) for a in m.parameters()]
    second = [np.zeros_like(a) for a in m.parameters()]
    for step in range(1, steps + 1 if len(names) > 1 else 1):
        y = r.integers(len(names), size=batch)
        x = windows[[r.choice(by[k]) for k in y]].T
        _, grads = _gradients(m, np.ascontiguousarray(x), y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - 0.95 * step / steps)
        for a, g, v, s in zip(m.parameters(), grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            v += 0.1 * (g - v)
            s += 0.001 * (g * g - s)
            a -= lr * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return m


def windows_of(data: bytes) -> np.ndarray:
    """(n, WINDOW): all bytes of a text, the last window filled up with blanks."""
    return np.frombuffer(data + b" " * (-len(data) % WINDOW), np.uint8).reshape(-1, WINDOW)


def predict(m: ByteRnn, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; UNKNOWN and 0 where a text has no letter. Memory is bounded by CHUNK windows beside the texts."""
    data = [t.encode() if t and any(map(str.isalpha, t)) else b"" for t in texts]
    sizes = np.array([len(d) for d in data])
    counts = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join([d + b" " * (-len(d) % WINDOW) for d in data]), np.uint8).reshape(-1, WINDOW)
    doc = np.repeat(np.arange(len(data)), counts)
    fill = np.full(len(flat), WINDOW)
    ends = np.cumsum(counts) - 1
    some = counts > 0
    fill[ends[some]] = (sizes[some] - 1) % WINDOW + 1
    sums = np.zeros((len(data), len(m.langs)))
    for s in range(0, len(flat), CHUNK):
        x = np.ascontiguousarray(flat[s : s + CHUNK].T)
        p = _probabilities(m, _forward(m, x)[0])
        short = np.flatnonzero(fill[s : s + CHUNK] < WINDOW)
        for k in short:
            p[:, fill[s + k] :, k] = 0
        np.add.at(sums, doc[s : s + CHUNK], p.sum(1).T)
    best = sums.argmax(1)
    score = sums[np.arange(len(data)), best] / np.maximum(sizes, 1)
    return [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, some)], [float(min(1.0, v)) if ok else 0.0 for v, ok in zip(score, some)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, per_doc: int = WINDOWS_PER_DOC) -> ByteRnn:
    """Trains on the rows of docs whose id, text and language are known. Without any, the model knows UNKNOWN alone.

    Rows of one id and text count once, with the smallest of their languages;
    different texts of one id count each. Of all these the fit_docs first by
    their hashes are taken, so a repeated id or row doesn't widen the sample.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    known = known.select(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    chosen = known.select("h", "th").distinct().orderBy("h", "th").limit(fit_docs)
    single = known.join(F.broadcast(chosen), ["h", "th"], "left_semi").groupBy("h", "th").agg(F.min(F.struct("lang", "text")).alias("x"))  # chosen: fit_docs rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, out = [], []
            for text, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = windows_of(text.encode())
                for k in sorted({int(i) for i in np.linspace(0, len(w) - 1, per_doc)}):
                    lang.append(name)
                    out.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "data"])

    rows = single.select("x.text", "x.lang").mapInArrow(cut, "lang string, data binary").collect()  # at most per_doc windows of each
    if not rows:
        return new_model([UNKNOWN])
    rows.sort()
    return train(np.frombuffer(b"".join(r["data"] for r in rows), np.uint8).reshape(-1, WINDOW), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: ByteRnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred string, score double for each row of docs, from the text alone.

    Null texts and texts without a letter are UNKNOWN with score 0. A model
    fitted on no label knows UNKNOWN alone and gives it to every other text with
    score 1. Repeated rows each get their result; other columns are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                lang, score = predict(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")
