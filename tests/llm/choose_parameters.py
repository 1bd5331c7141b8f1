"""Parameters of the two classifiers by cross-validation among the rows that they may learn from.

    python tests/llm/choose_parameters.py /root/testdata/check_s

Rows of the held-out fold are left out before anything is fitted or scored. Prints, for each setting, the accuracy
at 0.7 and the area under the curve, over three folds of the rest.
"""

from __future__ import annotations

import itertools
import os
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from forktrack.llm import labelled, quality, toxicity  # noqa: E402

ROWS = 6000
DATA: dict[str, tuple[list, np.ndarray, np.ndarray]] = {}


def load(folder: str, label: str, folds: int, held_out: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, labels and folds of at most ``ROWS`` rows outside the held-out fold, drawn by hash."""
    known = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", label]).to_pydict()
    marks = {i: y for i, y in zip(known["doc_id"], known[label]) if i is not None and y is not None and labelled.fold_of(i, folds) != held_out}
    drawn = set(sorted(marks, key=lambda i: zlib.crc32(b"draw %d" % i))[:ROWS])
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = sorted((i, t) for i, t in zip(docs["doc_id"], docs["text"]) if i in drawn)
    return [t for _, t in rows], np.array([marks[i] for i, _ in rows]), np.array([zlib.crc32(b"fold %d" % i) % 3 for i, _ in rows])


def area(y: np.ndarray, p: np.ndarray) -> float:
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = int(y.sum())
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n)))


def toxic(setting: dict, fold: int) -> tuple[float, float]:
    texts, y, of = DATA["toxic"]
    model = toxicity.fit([t for t, f in zip(texts, of) if f != fold], y[of != fold].tolist(), **setting)
    p = toxicity.score_texts(model, [t for t, f in zip(texts, of) if f == fold])
    return float(((p >= 0.7) == y[of == fold]).mean()), area(y[of == fold], p)


def good(setting: dict, fold: int) -> tuple[float, float]:
    texts, y, of = DATA["quality"]
    quality.REPEAT_TERMS = setting["repeat_terms"]
    own, asked = [t for t, f in zip(texts, of) if f != fold][:3000], [t for t, f in zip(texts, of) if f == fold]
    seen = np.bincount(np.concatenate([quality.terms(texts[at:at + 64])[1] for at in range(0, len(texts), 64)]), minlength=quality.BUCKETS)
    idf = np.log((1 + len(texts)) / (1 + seen)) + 0.1
    basis = quality.latent_basis([r for at in range(0, len(own), 64) for r in quality._dense(own[at:at + 64], idf)], setting["rank"])
    vectors = np.concatenate([quality._project(own[at:at + 64], idf, basis) for at in range(0, len(own), 64)])
    model = quality.Model(idf, basis, vectors, y[of != fold][:3000].astype(np.float32), setting["neighbours"], setting["power"])
    p = quality.score_texts(model, asked)
    return float(((p >= 0.7) == y[of == fold]).mean()), area(y[of == fold], p)


def main(folder: str) -> None:
    DATA["toxic"], DATA["quality"] = load(folder, "toxic", 3, 1), load(folder, "quality", 4, 2)
    grids = (
        (toxic, {"alpha": (0.5, 1.0, 2.0), "l1": (1.0, 2.0, 4.0)}),
        (good, {"rank": (32, 48), "neighbours": (7, 15, 31), "power": (2.0, 4.0), "repeat_terms": (1, 8)}),
    )
    with ProcessPoolExecutor(8) as pool:
        for run, grid in grids:
            settings = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
            jobs = [[pool.submit(run, s, f) for f in range(3)] for s in settings]
            scored = sorted(((np.mean([j.result() for j in own], axis=0).round(5).tolist(), s) for own, s in zip(jobs, settings)), key=lambda x: x[0], reverse=True)
            for (accuracy, auc), setting in scored:
                print(run.__name__, accuracy, auc, setting, flush=True)


if __name__ == "__main__":
    os.environ["OMP_NUM_THREADS"] = "1"
    main(sys.argv[1])
