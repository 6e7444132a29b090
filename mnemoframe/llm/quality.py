"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in the tasks and written once (a few dozen numbers a document). The trees are
grown on the driver from at most ``SAMPLE`` labelled rows, by gradient histograms over quantile bins, and flattened into
arrays that all trees share. Scoring walks all trees of a batch of rows at once with array indexing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.llm.langid import held_out
from mnemoframe.scratch import written

#: Labelled rows that the trees are grown from: those with the smallest hash of their id.
SAMPLE = 30_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 120, 4, 64, 0.1, 2.0, 12

FEATURES = (
    "log_chars", "log_words", "log_lines", "upper", "digit", "space", "beyond_ascii", "stops", "commas", "exclaim", "question", "quotes", "bars", "signs", "brackets", "slashes", "at_hash", "entropy", "squeezed",
    "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_next", "capital_words", "all_upper_words", "odd_end_words", "line_length", "same_lines", "stopped_lines", "bar_lines", "short_lines", "longest_line",
    "longest_run", "distinct_triples",
)
_RUN = re.compile(r"(\S)\1{3,}")


def _count(h: np.ndarray, chars: bytes) -> int:
    return int(h[list(chars)].sum())


def statistics(text: str | None) -> list[float]:
    """The numbers of ``FEATURES`` for a whole text; null counts as empty, and shares of nothing are 0."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = h[h > 0] / n
    w = text.split()
    nw = max(1, len(w))
    counts = Counter(w)
    top = counts.most_common(1)[0][1] if counts else 0
    lines = [x for x in text.split("\n") if x.strip()]
    nl = max(1, len(lines))
    letters = int(h[65:91].sum() + h[97:123].sum())
    return [
        np.log1p(len(text)), np.log1p(len(w)), np.log1p(len(lines)), int(h[65:91].sum()) / max(1, letters), int(h[48:58].sum()) / n, _count(h, b" \t\n\r") / n, int(h[128:].sum()) / n,
        _count(h, b".") / nw, _count(h, b",;:") / nw, _count(h, b"!") / nw, _count(h, b"?") / nw, _count(h, b"\"'`") / nw, _count(h, b"|") / nw, _count(h, b"$%&*+=~^") / nw, _count(h, b"(){}[]<>") / nw, _count(h, b"/\\") / nw, _count(h, b"@#_") / nw,
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0, len(zlib.compress(data, 1)) / n,
        len(text) / nw, sum(len(x) > 12 for x in w) / nw, sum(len(x) < 3 for x in w) / nw, len(counts) / nw, top / nw, sum(a == b for a, b in zip(w, w[1:], strict=False)) / nw,
        sum(x[0].isupper() for x in w) / nw, sum(len(x) > 1 and x.isupper() for x in w) / nw, sum(not x[-1].isalnum() and x[-1] not in ".,;:!?)\"'" for x in w) / nw,
        np.log1p(len(text) / nl), 1 - len(set(lines)) / nl if lines else 0.0, sum(x.rstrip()[-1] in ".!?" for x in lines) / nl, sum("|" in x for x in lines) / nl, sum(len(x) < 30 for x in lines) / nl, np.log1p(max(map(len, lines), default=0)),
        np.log1p(max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)), len(set(zip(w, w[1:], w[2:], strict=False))) / nw,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` (array<float>) for every row of ``docs``; other columns are not read."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])

    def work(batches):
        for b in batches:
            yield record(schema, [b.column(0), [[float(v) for v in statistics(t.as_py())] for t in b.column(1)]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, stats array<float>")


@dataclass
class Trees:
    """Boosted trees in shared arrays; a leaf points at itself."""

    feature: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.edge[node], self.left[node], self.right[node])
            out[lo : lo + 2048] = self.base + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2, least: int = LEAST_ROWS) -> Trees:
    """Boosted trees for the log loss. Without rows the score is 0.5 everywhere; with one label it is near that label."""
    arrays: dict[str, list] = {"feature": [], "edge": [], "left": [], "right": [], "value": []}
    roots = []
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nf = x.shape[1] if len(x) else 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(nf)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(nf)], axis=1).astype(np.int64) if nf else np.zeros((0, 0), np.int64)
    raw = np.full(len(y), base)
    offset = np.arange(nf) * bins

    def new_node(value: float) -> int:
        k = len(arrays["value"])
        for name, v in (("feature", 0), ("edge", np.inf), ("left", k), ("right", k), ("value", value)):
            arrays[name].append(v)
        return k

    for _ in range(trees if nf and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = new_node(-rate * g.sum() / (h.sum() + l2))
        roots.append(root)
        place = np.zeros(len(y), np.int64)
        nodes = np.array([root])
        for _ in range(depth):
            size = len(nodes) * nf * bins
            live = place >= 0
            key = (place[live, None] * (nf * bins) + offset + code[live]).ravel()
            gs, hs, ns = (np.bincount(key, np.repeat(v[live], nf), size).reshape(len(nodes), nf, bins) for v in (g, h, np.ones(len(y))))
            gl, hl, nl = (v.cumsum(axis=2) for v in (gs, hs, ns))
            gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            for f in range(nf):
                gain[:, f, len(edges[f]) :] = -1
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(len(nodes), -1).argmax(axis=1)
            top = gain.reshape(len(nodes), -1).max(axis=1)
            f, b = np.divmod(best, bins)
            next_nodes, child = [], np.full((len(nodes), 2), -1)
            for k, node in enumerate(nodes):
                if top[k] <= 1e-6:
                    continue
                sides = []
                for gsum, hsum in ((gl[k, f[k], b[k]], hl[k, f[k], b[k]]), (gt[k, 0, 0] - gl[k, f[k], b[k]], ht[k, 0, 0] - hl[k, f[k], b[k]])):
                    sides.append(new_node(-rate * gsum / (hsum + l2)))
                arrays["feature"][node], arrays["edge"][node] = int(f[k]), float(edges[f[k]][b[k]])
                arrays["left"][node], arrays["right"][node] = sides
                child[k] = len(next_nodes), len(next_nodes) + 1
                next_nodes += sides
            raw_done = live & (child[place, 0] < 0)
            raw[raw_done] += np.array(arrays["value"])[nodes[place[raw_done]]]
            place[raw_done] = -1
            going = np.flatnonzero(place >= 0)
            k = place[going]
            place[going] = np.where(code[going, f[k]] <= b[k], child[k, 0], child[k, 1])
            nodes = np.array(next_nodes, np.int64)
            if not len(nodes):
                break
        going = place >= 0
        raw[going] += np.array(arrays["value"])[nodes[place[going]]]
    return Trees(*(np.array(arrays[n], t) for n, t in (("feature", np.int64), ("edge", np.float64), ("left", np.int64), ("right", np.int64), ("value", np.float64))), np.array(roots, np.int64), base, depth)


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the rows of ``labels`` (doc_id, quality) whose document is not held out.

    At most ``sample`` rows are taken to the driver, those with the smallest hash of their id. Labels of one id that
    disagree count as the larger; null labels, and labels without a document, are ignored.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    # hashes above what the sample will need stay in the tasks, or every partition would send a whole sample
    span = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    needed = min(1.0, 1.5 * (sample + 1000) / max(1, marked.count()))
    known = stats.join(marked.where(place < F.lit(int(needed * span))), "doc_id").where(~held_out())
    rows = known.orderBy(place, "doc_id").limit(sample).select("stats", "label").toArrow()
    x = np.array(rows["stats"].to_pylist(), np.float32).astype(np.float64).reshape(rows.num_rows, len(FEATURES))
    return grow(x, np.array(rows["label"].to_pylist(), np.float64))


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score`` for every row of ``stats``."""
    known = stats.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            yield record(schema, [b.column(0), known.value.score(x)])

    return stats.select("doc_id", "stats").mapInArrow(work, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    found = score(stats, learn(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
