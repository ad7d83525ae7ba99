"""Distributed non-negative matrix factorisation X ~ W.H (squared Frobenius objective).

X is packed into blocks of documents (``blocks.py``); W lives as one dense row block a
document block, H (terms x K, bounded by the model's parameters) goes out in term blocks.

Start: NNDSVD (Boutsidis & Gallopoulos 2008) from a truncated SVD by a randomised range
finder (Halko et al. 2011): a sketch of K + 10 columns, power rounds Z <- X'(X orth(Z)),
a QR of the terms x (K + 10) sketch on the driver, and the eigenvectors of the small
matrix (XQ)'(XQ). No document id is ever computed with, so ids may be of any type.

Step: hierarchical alternating least squares (Cichocki & Phan 2009). A pass over X takes
X.H', replaces the columns of W one by one with their exact non-negative minimisers,
and adds up W'X and W'W; H is then updated in the same way, a chunk of terms a task. Every
column update minimises the objective exactly, so it never rises. ``solver="mu"`` makes
the multiplicative updates of Lee & Seung (2001) out of the same products.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_dropped
from .blocks import GRAM, DocBlocks, pack_docs

EPS = 1e-12
OVERSAMPLE, POWER_ROUNDS = 10, 2
SWEEPS = 3                     # column sweeps of a half step: cheap next to the pass over X

# --- fixed values of the hashed start, as the SQL check has them --------------
START_DIGITS, START_MOD = 8, 100_000
# ---------------------------------------------------------------------------


def hashed_start(rows: DataFrame, key: str, name: str, n_topics: int, seed: int = 0) -> DataFrame:
    """(key, name array): values in (0, 1] from the md5 of key, topic and seed, for keys
    of any type and seeds of any size."""
    def value(k):
        text = F.concat_ws(":", F.col(key).cast("string"), k.cast("string"), F.lit(str(seed)))
        digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, START_DIGITS), 16, 10).cast("long")
        return (digits % START_MOD + 1) / float(START_MOD)
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_topics - 1)), value).alias(name))


def hals(current: np.ndarray, product: np.ndarray, gram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Columns of ``current`` replaced in turn by their exact non-negative minimisers,
    given product = X.B and gram = B'B for the fixed factor B. A column of B without
    weight leaves its column as it is."""
    w = current.copy()
    for _ in range(sweeps):
        for k in np.flatnonzero(np.diag(gram) > 0):
            w[:, k] = np.maximum(w[:, k] + (product[:, k] - w @ gram[:, k]) / gram[k, k], 0)
    return w


def multiplied(current: np.ndarray, product: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return current * product / (current @ gram + EPS)


SOLVERS = {"hals": hals, "mu": multiplied}


def orthonormal(z: np.ndarray) -> np.ndarray:
    return np.linalg.qr(z)[0] if z.size else z


@dataclass
class NMFResult:
    W: DataFrame            # (article_id, w array<double>), a row for every document
    H: DataFrame            # (term, h array<double>)
    history: DataFrame      # (iteration, objective)
    n_topics: int

    def topic_terms(self) -> DataFrame:
        """Long H: (topic, term, weight)."""
        return self.H.select("term", F.posexplode("h").alias("topic", "weight")).select(
            "topic", "term", "weight")


class TopicFactors:
    """Driver loop of Spark jobs; see the module docstring for the plan."""

    def __init__(self, doc_terms: DataFrame, terms: DataFrame, n_topics: int, seed: int = 0,
                 max_features: int | None = None, docs: DataFrame | None = None, init: str = "nndsvd",
                 solver: str = "hals", packed: tuple[DataFrame, np.ndarray] | None = None):
        self.spark, self.k, self.seed, self.init, self.solver = doc_terms.sparkSession, n_topics, seed, init, SOLVERS[solver]
        self.terms = terms.select("term", "term_id")
        start = None
        if init == "hash":
            own = doc_terms.select("article_id") if docs is None else docs.select("article_id")
            start = hashed_start(own.distinct(), "article_id", "w", n_topics, seed)
        elif init != "nndsvd":
            raise ValueError(f"unknown start {init!r}")
        size = self.terms.agg(F.max("term_id").alias("last")).first()["last"]
        if packed is not None and start is None:
            self.packed, idf = packed
            squares = self.packed.agg(F.sum("squares"))
        else:
            self.packed, idf = pack_docs(doc_terms, terms, docs, max_features, start), None
            squares = doc_terms.join(F.broadcast(self.terms) if max_features else self.terms, "term").agg(
                F.sum(F.col("tfidf") * F.col("tfidf")))
        self.x = DocBlocks(self.packed, 0 if size is None else size + 1, idf=idf)
        self.xx = float(squares.first()[0] or 0.0)

    def svd(self) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """(state with B = X.Q, R, singular values): B.R has the left vectors, scaled by the
        values, of the K largest; the right vectors are Q.R."""
        x, columns = self.x, min(self.k + OVERSAMPLE, self.x.n_terms)
        z = orthonormal(np.random.default_rng(abs(self.seed)).standard_normal((x.n_terms, columns)))
        for _ in range(1 + POWER_ROUNDS):
            state = x.run(z, _product)
            z = orthonormal(x.transposed(state, columns))
        state = x.run(z, _product, transposed=False, gram=True)
        values, vectors = np.linalg.eigh(x.gram(state, columns))
        order = np.argsort(-values)[:self.k]
        self.basis = z
        return state, vectors[:, order], np.sqrt(np.maximum(values[order], 0))

    def start(self) -> tuple[DataFrame, np.ndarray]:
        """(state with W, H as terms x K)."""
        k = self.k
        if self.init == "hash":
            h = np.zeros((self.x.n_terms, k))
            for r in hashed_start(self.terms, "term", "h", k, self.seed).join(self.terms, "term").toLocalIterator():
                h[r["term_id"]] = r["h"]
            return self.packed.select("block", F.col("start").alias("dense")), h
        state, turn, values = self.svd()
        some = values > EPS * max(1.0, values.max(initial=0))
        turn = turn[:, some] / values[some]                          # B.turn has unit columns
        right = self.basis @ (turn * values[some])
        columns = right.shape[1]
        sides = state.where("block is not null").select("dense").mapInArrow(
            _sides(turn), "part binary").select(F.lit(GRAM).alias("chunk"), "part")
        sums = self.x.merged(sides, True).first()
        up, down = np.frombuffer(sums["part"]).reshape(2, columns) if sums else np.zeros((2, columns))
        r_up, r_down = (np.maximum(right, 0) ** 2).sum(0), (np.maximum(-right, 0) ** 2).sum(0)
        sign = np.where(up * r_up >= down * r_down, 1.0, -1.0)
        norm_u, norm_r = np.sqrt(np.where(sign > 0, up, down)), np.sqrt(np.where(sign > 0, r_up, r_down))
        scale = np.sqrt(values[some] * norm_u * norm_r)
        h, turn_w = np.zeros((self.x.n_terms, k)), np.zeros((turn.shape[0], k))
        h[:, :columns] = np.maximum(right * sign, 0) * scale / np.maximum(norm_r, EPS)
        turn_w[:, :columns] = turn * sign * scale / np.maximum(norm_u, EPS)
        rows = state.where("block is not null").select("block", "dense").mapInArrow(_started(turn_w), "block long, dense binary")
        return rows, h

    def step_w(self, state: DataFrame, h: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        """(state with the new W and the parts of W'X, W'W)."""
        gram, solver = h.T @ h, self.solver
        state = self.x.run(h, lambda w, xh: solver(w, xh, gram), state, gram=True)
        return state, self.x.gram(state, self.k)

    def step_h(self, state: DataFrame, h: np.ndarray, wtw: np.ndarray) -> tuple[np.ndarray, DataFrame, float]:
        """(H, its chunks, the sum of W'X o H). Terms are updated where their W'X is merged;
        a term that no document has goes to zero."""
        k, solver, chunk = self.k, self.solver, self.x.chunk_terms(self.k)
        sent = self.x.sent(h)

        def run(batches):
            for batch in batches:
                for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    low, own = next((b for b in reversed(sent) if b[0] <= c * chunk))
                    wtx = np.frombuffer(part).reshape(-1, k)
                    new = solver(own.value[c * chunk - low:c * chunk - low + len(wtx)], wtx, wtw)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], pa.int32()), pa.array([new.tobytes()], pa.binary()), pa.array([float((new * wtx).sum())])],
                        names=["chunk", "h", "cross"])
        schema = "chunk int, h binary, cross double"
        chunks = self.x.stored(self.x.merged(state, False).mapInArrow(run, schema), "chunks", schema)
        for _, block in sent:
            block.destroy()
        new, cross = np.zeros_like(h), 0.0
        for r in chunks.collect():                                   # terms x K numbers, a model parameter
            part = np.frombuffer(r["h"]).reshape(-1, k)
            new[r["chunk"] * chunk:r["chunk"] * chunk + len(part)] = part
            cross += r["cross"]
        return new, chunks, cross

    def terms_of(self, chunks: DataFrame | None) -> DataFrame:
        """(term, h array<double>) of every term of the vocabulary."""
        k, chunk = self.k, self.x.chunk_terms(self.k)

        def run(batches):
            for batch in batches:
                for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    values = np.frombuffer(part)
                    n = len(values) // k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(n) + c * chunk, pa.int32()),
                         pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values))],
                        names=["term_id", "h"])
        rows = (chunks.select("chunk", "h").mapInArrow(run, "term_id int, h array<double>") if chunks is not None
                else self.spark.createDataFrame([], "term_id int, h array<double>"))
        zeros = F.array_repeat(F.lit(0.0), k)
        return self.terms.join(rows, "term_id", "left").select("term", F.coalesce("h", zeros).alias("h"))

    def fit(self, max_iter: int = 200, tol: float = 1e-4) -> NMFResult:
        """Iterate until the objective falls by less than ``tol`` of itself, or
        ``max_iter`` times. An empty X has zeros in W and H and no history."""
        history, chunks, before = [], None, None
        state, h = self.start() if self.xx > 0 else (None, None)
        for it in range(1, (max_iter if self.xx > 0 else 0) + 1):
            state, wtw = self.step_w(state, h)
            h, chunks, cross = self.step_h(state, h, wtw)
            now = max(0.0, self.xx - 2.0 * cross + float((wtw * (h.T @ h)).sum()))
            history.append((it, now))
            if now == 0 or before is not None and (before - now) / before < tol:
                break
            before = now
        if state is None:
            k = self.k
            state = self.packed.select("block", "ids").mapInArrow(_zeros(k), "block long, dense binary")
        w = self.x.rows(state)
        result = NMFResult(w, self.terms_of(chunks), self.spark.createDataFrame(history, "iteration int, objective double"), self.k)
        self.close()
        return result

    def close(self) -> None:
        """Release the kept blocks (W and H live in checkpoint files)."""
        self.x.close()


def _product(_, y):
    return y


def _sides(turn: np.ndarray):
    """Per task: the squares of the positive and of the negative sides of B.turn."""
    def run(batches):
        total = np.zeros((2, turn.shape[1]))
        for batch in batches:
            for dense in batch.column(0).to_pylist():
                u = np.frombuffer(dense).reshape(-1, turn.shape[0]) @ turn
                total += [(np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
    return run


def _started(turn: np.ndarray):
    def run(batches):
        for batch in batches:
            dense = [np.maximum(np.frombuffer(d).reshape(-1, turn.shape[0]) @ turn, 0).tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dense, pa.binary())], names=["block", "dense"])
    return run


def _zeros(k: int):
    def run(batches):
        for batch in batches:
            dense = [np.zeros(len(ids) * k).tobytes() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dense, pa.binary())], names=["block", "dense"])
    return run


def nmf_fit(doc_terms: DataFrame, terms: DataFrame, n_topics: int = 20, max_iter: int = 200,
            tol: float = 1e-4, seed: int = 0, max_features: int | None = None, docs: DataFrame | None = None,
            init: str = "nndsvd", solver: str = "hals", packed: tuple[DataFrame, np.ndarray] | None = None) -> NMFResult:
    """Factorise X (doc_terms) into W (documents x K) and H (K x terms). ``docs``
    (article_id) gives documents without vocabulary terms their (zero) row of W. ``packed``
    is X with all documents as ``packed_weights`` gives it: nothing is packed anew then."""
    with shuffles_dropped(doc_terms.sparkSession):
        return TopicFactors(doc_terms, terms, n_topics, seed, max_features, docs, init, solver, packed).fit(max_iter, tol)


def nmf_step(doc_terms: DataFrame, terms: DataFrame, n_topics: int, seed: int = 0,
             max_features: int | None = None, solver: str = "mu") -> tuple[DataFrame, DataFrame]:
    """One update of W, then of H, from the hashed start: (W1, H1)."""
    with shuffles_dropped(doc_terms.sparkSession):
        m = TopicFactors(doc_terms, terms, n_topics, seed, max_features, init="hash", solver=solver)
        state, h = m.start()
        state, wtw = m.step_w(state, h)
        _, chunks, _ = m.step_h(state, h, wtw)
        out = m.x.rows(state), m.terms_of(chunks)
        m.close()
    return out
