"""Toxicity: a cumulative-link (proportional odds) model of ordered severity grades.

P(grade <= k | x) = sigmoid(theta_k - w.x) with one weight vector for all
thresholds theta_1 <= theta_2 <= ...; x is sparse: log2(1 + count) of each
word and of each word beginning that the fitted vocabulary holds. The output is the expected severity
E[grade] = sum over k of P(grade >= k), the likeliest grade and P(grade >= 1).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches

#: At most so many labelled documents, those with the smallest hash of their id, are fetched to fit the model.
FIT_ROWS = 4000
#: A document whose P(grade >= 1) reaches this is toxic.
REJECT_AT = 0.25

#: ASCII letters in lower case and all bytes of other scripts stay; the rest are blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def features_of(words: list[bytes]) -> dict[bytes, int]:
    """Counts of words and, after a tilde, of the first 4 and 5 bytes of words longer than that."""
    count = Counter(words)
    out = dict(count)
    for w, c in count.items():
        for n in (4, 5):
            if len(w) > n:
                key = b"~" + w[:n]
                out[key] = out.get(key, 0) + c
    return out


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: np.ndarray  # rising

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one column for each."""
        z = np.clip(np.asarray(score, float)[:, None] - self.thresholds[None, :], -700, 700)
        return 1 / (1 + np.exp(-z))


def _gradient(z: np.ndarray, grade: np.ndarray, theta: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted mean negative log likelihood: by score, and by threshold."""
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    up, low = sig(edge[grade + 1] - z), sig(edge[grade] - z)
    up[grade == len(theta)], low[grade == 0] = 1, 0
    mass = np.maximum(up - low, 1e-12)
    d_up, d_low = heavy * up * (1 - up) / mass, heavy * low * (1 - low) / mass
    n = heavy.sum()
    by_theta = np.zeros(len(theta))
    for k in range(len(theta)):
        by_theta[k] = (d_low[grade == k + 1].sum() - d_up[grade == k].sum()) / n
    return (d_up - d_low) / n, by_theta


def fit_ordinal(docs: list[list[bytes]], grades: list[int], min_docs: int = 5, min_z: float = 4.0, l2: float = 1e-3, steps: int = 300, rate: float = 0.05, most_weight: float = 3.0) -> OrdinalModel:
    """Fits by Adam.

    Features need `min_docs` documents and a log odds ratio of toxic against
    other documents at least `min_z` standard errors from 0. Grades over 0
    weigh as much in sum as grade 0, up to `most_weight` times each.
    """
    grade = np.asarray(grades, int)
    top = int(grade.max(initial=0))
    if top == 0:
        return OrdinalModel({}, np.array([np.inf]))
    counts = [features_of(d) for d in docs]
    seen = Counter(w for d in counts for w in d)
    bad = Counter(w for d, g in zip(counts, grade) for w in d if g > 0)
    n_bad = int((grade > 0).sum())

    def telling(w: bytes, c: int) -> bool:
        a, b = bad[w] + 0.5, c - bad[w] + 0.5
        a_not, b_not = max(n_bad - a, 0) + 0.5, max(len(grade) - n_bad - b, 0) + 0.5
        return abs(math.log(a * b_not / (a_not * b))) >= min_z * math.sqrt(1 / a + 1 / a_not + 1 / b + 1 / b_not)

    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= min_docs and telling(w, c)))}
    if not vocabulary:  # nothing tells toxic documents from others
        return OrdinalModel({}, np.array([np.inf]))
    row = np.array([r for r, d in enumerate(counts) for w in d if w in vocabulary], np.int64)
    col = np.array([vocabulary[w] for d in counts for w in d if w in vocabulary], np.int64)
    val = np.log2(1 + np.array([c for d in counts for w, c in d.items() if w in vocabulary], float))
    heavy = np.where(grade > 0, min(most_weight, (grade == 0).sum() / max(1, (grade > 0).sum())), 1.0)
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)])
    theta = np.maximum.accumulate(-np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    w = np.zeros(len(vocabulary))
    m = [np.zeros_like(w), np.zeros_like(theta)]
    v = [np.zeros_like(w), np.zeros_like(theta)]
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col] * val, len(grade))
        g_z, g_theta = _gradient(z, grade, theta, heavy)
        g = [np.bincount(col, g_z[row] * val, len(w)) + l2 * w, g_theta]
        for i, x in enumerate((w, theta)):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        theta[:] = np.maximum.accumulate(theta)
    return OrdinalModel({x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 1e-4}, theta)


def grades_from_binary(docs: list[list[bytes]], toxic: list[int], most: int = 3) -> list[int]:
    """Ordered grades where labels know only toxic or not.

    A feature is charged if it is in at least 5 toxic documents and its odds
    there are at least 20 times those in the others. A toxic document's grade
    is 1 plus the number of terciles (among toxic documents) that its count of
    charged features exceeds.
    """
    counts = [features_of(d) for d in docs]
    here = Counter(w for d, t in zip(counts, toxic) if t for w in d)
    there = Counter(w for d, t in zip(counts, toxic) if not t for w in d)
    n_toxic = sum(toxic)
    odds = lambda c, n: (c + 0.5) / (n - c + 0.5)
    charged = {w for w, c in here.items() if c >= 5 and odds(c, n_toxic) >= 20 * odds(there[w], len(docs) - n_toxic)}
    amount = np.array([sum(c for w, c in d.items() if w in charged) for d in counts])
    bad = amount[np.asarray(toxic, bool)]
    cuts = np.quantile(bad, [i / most for i in range(1, most)]) if len(bad) else []
    return [int(1 + sum(x > c for c in cuts)) if t else 0 for x, t in zip(amount, toxic)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", graded: bool = False, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most `fit_rows` labelled documents; graded: label_col holds grades 0.. instead of 0 and 1.

    An id with several labels has the highest. Rows of one id and text count
    once, different texts of one id each, the first fit_rows by the hash of id
    and text; of documents with equal texts the one with the smallest id counts.
    Ids may be numbers or texts. Null ids, labels and unlabelled documents take
    no part, a null text counts as empty. Without toxic labels nothing is toxic.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    # The bounded choice comes before the join, so only the chosen texts move.
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = texts.groupBy("_id", "_label", F.xxhash64("_text").alias("_th")).agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("_id"), "_id", "_th").limit(fit_rows).collect()
    # Copies would count one document's words many times over.
    single: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: r["_id"]):
        single.setdefault(r["_text"], r)
    words, marks = [words_of(text) for text in single], [r["_label"] for r in single.values()]
    return fit_ordinal(words, marks if graded else grades_from_binary(words, marks))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """Adds severity double, grade int, p_toxic double and is_toxic boolean to docs.

    Whole texts are read, each row for itself, repeated ones alike. Null and
    empty texts have no words, so they get the severity of the thresholds
    alone. Of equally likely grades the lowest is given. Columns of docs with
    these four names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["severity", "grade", "p_toxic", "is_toxic"]
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = docs.select(*kept).schema.add("severity", "double").add("grade", "integer").add("p_toxic", "double").add("is_toxic", "boolean")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, weight = model.weights, model.weights.get
        for b in batches:
            z = np.array([sum(weight(w, 0.0) * math.log2(1 + c) for w, c in features_of(words_of(t)).items() if w in weights) for t in b.column(at).to_pylist()], float)
            over = model.at_least(z)
            mass = -np.diff(np.hstack([np.ones((len(z), 1)), over, np.zeros((len(z), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(over.sum(1)), pa.array(mass.argmax(1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] >= reject_at)], [*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)
