"""URL rules, and gradient-boosted trees on lexical features where no rule fits.

Rules decide what they fit. The trees learn from labelled URLs, which the
caller gives; without any, from those that a rule decides, and then carry the
rules over to URLs that look alike. They are fitted on a bounded sample, with features that count
the labels of all URLs by host suffix; every URL is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from heronry.llm.html_extract import url_host
from heronry.llm.scratch import cut, small_or_not


class Rule(NamedTuple):
    verdict: str  #: allow or block
    host: str  #: fits this host and its subdomains
    path: str  #: fits paths that start so

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Labelled URLs that the trees are fitted on, at most.
FIT_ROWS = 20_000
#: Suffixes of one kind whose counts are broadcast, at most.
BROADCAST_SUFFIXES = 250_000
SUFFIXES = ("suffix1", "suffix2", "suffix3", "first_step")

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "query_length", "hyphens", "suffix1", "suffix2", "suffix3", "first_step")


def url_path(url: Column) -> Column:
    """What stands between the host and the next ``?`` or ``#``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _suffixes(url: str) -> tuple[str, str, str, str]:
    """The last one, two and three labels of the host, and the last label with the first step of the path."""
    rest = url.partition("://")[2]
    host = rest.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    labels = host.split(".")
    step = rest[len(host) :].split("?", 1)[0].split("#", 1)[0].split("/")[1:2]
    return labels[-1], ".".join(labels[-2:]), ".".join(labels[-3:]), f"{labels[-1]}/{step[0] if step else ''}"


def shrunk(n, bad, overall: float, weight: float = 5.0):
    """The rate ``bad / n``, with ``weight`` more labels at the overall rate."""
    return (bad + weight * overall) / (n + weight)


@dataclass
class SuffixRates:
    """How often labelled URLs with a host suffix are to be blocked, shrunk to the overall rate; for labels in a list."""

    overall: float = 0.0
    tables: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}, {}, {}, {}])
    weight: float = 5.0

    @classmethod
    def fit(cls, urls: list[str], block: np.ndarray) -> SuffixRates:
        out = cls(float(block.mean()) if len(block) else 0.0)
        keys = [_suffixes(u) for u in urls]
        for k in range(4):
            n, bad = Counter(x[k] for x in keys), Counter(x[k] for x, y in zip(keys, block, strict=True) if y)
            out.tables[k] = {s: (n[s], bad[s]) for s in n}
        return out

    def rates(self, urls: list[str], without: np.ndarray | None = None) -> np.ndarray:
        """A row for each URL; with its own label left out if ``without`` has it."""
        out = np.empty((len(urls), 4))
        for i, u in enumerate(urls):
            for k, s in enumerate(_suffixes(u)):
                n, bad = self.tables[k].get(s, (0, 0))
                if without is not None:
                    n, bad = n - 1, bad - int(without[i])
                out[i, k] = shrunk(n, bad, self.overall, self.weight)
        return out


def features(urls: list[str], rates: np.ndarray) -> np.ndarray:
    """The lexical features of every URL, with ``rates`` as its suffix statistics."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, u in enumerate(urls):
        rest = u.partition("://")[2]
        host = rest.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
        tail = rest[len(host) :].split("#", 1)[0]
        path, _, query = tail.partition("?")
        counts = Counter(host)
        entropy = -sum(c / len(host) * math.log2(c / len(host)) for c in counts.values()) if host else 0.0
        out[i, :10] = (
            len(u), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + 1 if host else 0,
            sum(c.isdigit() for c in u) / max(1, len(u)), entropy, sum(1 for p in query.split("&") if p), len(query), host.count("-"),
        )
    out[:, 10:] = rates
    return out


@dataclass
class BoostedTrees:
    """Logistic gradient boosting of small histogram trees; a tree is a flat list of nodes."""

    trees: list[np.ndarray] = field(default_factory=list)  # rows: feature, cut, left, right, value
    start: float = 0.0
    rate: float = 0.2

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, n_trees: int = 40, depth: int = 3, bins: int = 32, least: float = 5.0) -> BoostedTrees:
        out = cls()
        mean = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
        out.start = math.log(mean / (1 - mean))
        if not len(y) or y.min() == y.max():
            return out
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        z = np.full(len(y), out.start)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (y - p), w * p * (1 - p)
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                me = len(nodes)
                sg, sh = g[rows].sum(), h[rows].sum()  # noqa: B023
                nodes.append([-1, 0.0, -1, -1, sg / (sh + 1.0)])
                if level == depth or len(rows) < 2 * least:
                    return me
                best = (1e-6, -1, 0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    bg, bh, bn = (np.bincount(b, v, len(c) + 1).cumsum()[:-1] for v in (g[rows], h[rows], None))  # noqa: B023
                    gain = bg**2 / (bh + 1.0) + (sg - bg) ** 2 / (sh - bh + 1.0) - sg**2 / (sh + 1.0)
                    gain[(bn < least) | (len(rows) - bn < least)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
                if best[1] >= 0:
                    _, f, k = best
                    left = binned[rows, f] <= k
                    nodes[me][:2] = f, float(cuts[f][k])
                    nodes[me][2] = grow(rows[left], level + 1)
                    nodes[me][3] = grow(rows[~left], level + 1)
                return me

            grow(np.arange(len(y)), 0)
            tree = np.array(nodes)
            tree[:, 4] *= out.rate
            out.trees.append(tree)
            z += cls._leaf(tree, x)
        return out

    @staticmethod
    def _leaf(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(tree[at, 0] >= 0)
            if not len(inner):
                return tree[at, 4]
            node = tree[at[inner]]
            left = x[inner, node[:, 0].astype(int)] <= node[:, 1]
            at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += self._leaf(tree, x)
        return 1 / (1 + np.exp(-z))


def _suffixed(rows: DataFrame) -> DataFrame:
    """``rows``, which have a ``url``, with its four suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_suffixes(u or "") for u in b.column(b.schema.get_field_index("url")).to_pylist()]
            added = [pa.array([x[k] for x in keys], pa.string()) for k in range(4)]
            yield pa.record_batch([*b.columns, *added], names=[*b.schema.names, *SUFFIXES])

    fields = [StructField(f.name, f.dataType) for f in rows.schema] + [StructField(s, StringType()) for s in SUFFIXES]
    return rows.mapInArrow(run, StructType(fields))


def _counted(suffixed: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """The rows with arrays ``n`` and ``bad`` of the four counts of their suffixes, in place of these."""
    out = suffixed
    for s, table in zip(SUFFIXES, counts, strict=True):
        out = out.join(small_or_not(table, BROADCAST_SUFFIXES), s, "left")
    at = [F.array(*(F.coalesce(F.col(f"{c}_{s}"), F.lit(0)).cast("double") for s in SUFFIXES)).alias(c) for c in ("n", "bad")]
    return out.select(*(c for c in suffixed.columns if c not in SUFFIXES), *at)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)


class UrlModel(NamedTuple):
    counts: list[DataFrame]  #: rows ``(suffix, n_suffix, bad_suffix)`` over all labelled URLs, for each of SUFFIXES
    overall: float  #: share of labelled URLs to block
    trees: BoostedTrees

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have a ``url``, with ``score``, the probability to be one to block."""
        overall, trees, names = self.overall, self.trees, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, bad = (_flat(b.column(len(names) + i)) for i in (0, 1))
                urls = [u or "" for u in b.column(names.index("url")).to_pylist()]
                yield pa.record_batch([*b.columns[: len(names)], pa.array(trees.probability(features(urls, shrunk(n, bad, overall))))], names=[*names, "score"])

        fields = [StructField(f.name, f.dataType) for f in rows.schema] + [StructField("score", DoubleType())]
        return _counted(_suffixed(rows), self.counts).mapInArrow(run, StructType(fields))

    def probability(self, urls: list[str]) -> np.ndarray:
        """The probability of each URL of a list to be one to block."""
        rows = self.counts[0].sparkSession.createDataFrame(list(enumerate(urls)), "at long, url string")
        return self.scored(rows).orderBy("at").toArrow().column("score").to_numpy()


def fit_urls(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> UrlModel:
    """A model from rows ``(url, block int)``.

    Suffixes are counted over all distinct labelled URLs, one to block if any
    of its rows is. For the trees they are taken in order of a hash,
    ``fit_rows`` at most, blocked and allowed ones apart and half of the bound
    each, with their own label left out of the counts.
    """
    distinct = labelled.where("url is not null and block is not null").groupBy("url").agg(F.max("block").alias("block"))
    known = cut(_suffixed(distinct), "labelled-urls")
    counts = [cut(known.groupBy(s).agg(F.count("*").alias(f"n_{s}"), F.sum("block").alias(f"bad_{s}")), f"counts-{s}") for s in SUFFIXES]
    overall = float(known.agg(F.coalesce(F.avg("block"), F.lit(0.0))).first()[0])
    parts = [known.where(F.col("block") == b).orderBy(F.xxhash64("url"), "url").limit(fit_rows // 2) for b in (0, 1)]
    rows = _counted(parts[0].union(parts[1]), counts).orderBy("block", "url").toArrow().combine_chunks()
    urls, block = rows.column("url").to_pylist(), np.asarray(rows.column("block").to_pylist(), float)
    if urls:
        n, bad = (_flat(rows.column(c).combine_chunks()) for c in ("n", "bad"))
        x = features(urls, shrunk(n - 1, bad - block[:, None], overall))
    else:
        x = np.zeros((0, len(FEATURES)))
    return UrlModel(counts, overall, BoostedTrees.fit(x, block, np.ones(len(block))))


def label_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows ``(url, block)`` of the URLs that a rule fits: 1 if it blocks."""
    url = F.col(url_col).cast("string")
    rows = pages.select(url.alias("url"), fitting_rule(url_host(url), url_path(url), rules).alias("fit"))
    return rows.where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("int").alias("block"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = RULES,
    labelled: DataFrame | None = None,
    fit_rows: int = FIT_ROWS,
    threshold: float = 0.5,
) -> DataFrame:
    """One row ``(page_id, host, path, rule, verdict, score)`` per row of ``pages``.

    The verdict is the longest fitting rule's, of rules of equal length the
    last one's, else ``block`` if the trees give ``threshold`` or more; ``score``
    is their probability to block. Trees are fitted on ``labelled(url, block)``,
    or without it on what the rules say of the pages' own URLs; if all labels
    agree, or there are none, every score is one number. Null URLs and URLs
    without ``://`` have empty host and path and are allowed. URLs of any length
    are read whole. Repeated rows give rows of their own, an empty table none;
    other columns are not read, whatever their names.
    """
    model = fit_urls(label_urls(pages, url_col, rules) if labelled is None else labelled, fit_rows)
    url = F.col("url")
    scored = model.scored(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    placed = scored.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), "score")
    ruled = placed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("score") >= threshold) & (F.col("host") != ""), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")
