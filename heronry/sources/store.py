"""A versioned store of one corpus's token vectors: immutable Parquet segments and a manifest.

``manifest.json`` is the only file that changes. It lists segments, oldest
first, and tombstone tables; replacing it by rename is what makes a commit
visible. A document is present with the row of the last segment that holds it,
unless a tombstone names that row. Commits never delete files, so running
queries keep what they planned to read; ``vacuum`` does, when told to.
"""

from __future__ import annotations

import json
import re
import secrets
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from pathlib import Path
from typing import Literal, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.kernel import check_packed
from heronry.functions.vectors import all_finite, int8_codes, int8_scale
from heronry.model import Representation, document_ids
from heronry.operators.presence import present_rows
from heronry.sources import files

FORMAT = "heronry-vectors-1"
SEMANTICS = {"float32": "float32-exact-full-maxsim", "int8": "int8-reconstructed-approximate-full-maxsim"}
UNIT_TOLERANCE = 1.1e-3
_MAX_ID = 2**63 - 1
#: Requested ids that are broadcast, at most, by number and by characters.
BROADCAST_IDS, BROADCAST_CHARS = 1_000_000, 32 << 20
#: Times that a read is planned again because files of its commit are gone.
ATTEMPTS = 8
T = TypeVar("T")


def segment_schema(encoding: str) -> str:
    values = "codes array<tinyint>, scales array<float>" if encoding == "int8" else "vectors array<float>"
    return f"segment_id long, row long, doc_id string, token_count int, {values}"


@dataclass(frozen=True)
class Manifest:
    store_id: str
    encoding: str
    corpus: str
    representation: Representation
    commit: int
    next_id: int
    committed_at: float
    segments: tuple[tuple[int, int, int], ...]  #: id, documents, tokens
    tombstones: tuple[int, ...]

    def to_json(self) -> str:
        segments = [{"id": i, "documents": d, "tokens": t} for i, d, t in self.segments]
        return json.dumps({"format": FORMAT, **self.__dict__, "representation": self.representation.to_dict(), "segments": segments, "tombstones": list(self.tombstones)}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        """The manifest in ``text``, or a ValueError that says what is wrong with it."""
        try:
            value = json.loads(text)
            found = value.pop("format")
            if found != FORMAT:
                raise ValueError(f"the store has format {found!r}; {FORMAT!r} can be read")
            segments = tuple((s["id"], s["documents"], s["tokens"]) for s in value.pop("segments"))
            out = cls(**value | {"representation": Representation.from_dict(value["representation"]), "segments": segments, "tombstones": tuple(value["tombstones"])})
        except (KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"the manifest can't be read: {e!r}") from e
        numbers = [out.commit, out.next_id, *out.tombstones, *(n for s in out.segments for n in s)]
        if any(isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= _MAX_ID for n in numbers):
            raise ValueError("the manifest holds a number outside of 0 to 2**63 - 1")
        ids = [s[0] for s in out.segments]
        if out.encoding not in SEMANTICS:
            raise ValueError(f"unknown encoding {out.encoding!r}")
        if not out.corpus or not out.store_id:
            raise ValueError("corpus and store_id must not be empty")
        if not out.committed_at >= 0:
            raise ValueError("committed_at must not be negative")
        if ids != sorted(set(ids)) or list(out.tombstones) != sorted(set(out.tombstones)):
            raise ValueError("segments and tombstones must be in strictly ascending order")
        if max([-1, *ids, *out.tombstones]) >= out.next_id:
            raise ValueError("next_id must be above every id in use")
        return out


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def _read(spark: SparkSession, path: str, m: Manifest) -> tuple[DataFrame, DataFrame | None]:
    """All rows of the manifest's segments, and its tombstones."""
    schema = segment_schema(m.encoding)
    rows = spark.read.schema(schema).parquet(*(f"{path}/segment-{s[0]}" for s in m.segments)) if m.segments else spark.createDataFrame([], schema)
    gone = spark.read.schema("segment_id long, row long").parquet(*(f"{path}/tombstones-{t}" for t in m.tombstones)) if m.tombstones else None
    return rows, gone


class StoreView:
    """One commit of a store; later commits don't change it."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.rows, self.tombstones = _read(spark, path, manifest)

    @property
    def as_of(self) -> datetime:
        return datetime.fromtimestamp(self.manifest.committed_at, timezone.utc)

    @property
    def commit(self) -> int:
        return self.manifest.commit

    def present(self, ids: DataFrame | None = None) -> DataFrame:
        """Present documents with their vectors, those in ``ids(doc_id)`` only if given.

        ``ids`` should be few: it is what keeps other documents from being
        aggregated, and vectors from being read.
        """
        rows = self.rows if ids is None else self.rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        live = present_rows(rows.select("doc_id", "segment_id", "row"), self.tombstones)
        if len(self.manifest.segments) == 1 and self.tombstones is None:
            return rows  # one segment holds a document once
        return rows.join(live, ["doc_id", "segment_id", "row"], "left_semi")

    def index(self) -> DataFrame:
        """Rows ``(doc_id, token_count)`` of present documents; no vectors are read."""
        return self.present().select("doc_id", "token_count")

    def lengths(self, ids: DataFrame) -> DataFrame:
        """``ids``, which have a ``doc_id``, with ``token_count``, null where the document isn't present."""
        held = self.present(ids).select("doc_id", "token_count")
        return ids.join(held, "doc_id", "left")

    def fetched(self, ids: DataFrame) -> DataFrame:
        """``ids(doc_id, ...)``, repeats included, with ``token_count`` and the stored values; an absent id is an error when rows are computed.

        The form of ``fetch`` for any number of ids: nothing comes to the driver.
        """
        held = self.present(ids).drop("segment_id", "row").withColumn("__held", F.lit(True))
        joined = ids.join(held, "doc_id", "left")
        missing = F.raise_error(F.concat(F.lit("document "), F.coalesce("doc_id", F.lit("null")), F.lit(" is not in the vector store")))
        return joined.withColumn("token_count", F.when(F.col("__held"), F.col("token_count")).otherwise(missing.cast("int"))).drop("__held")

    def _ids(self, ids: Sequence[str]) -> DataFrame:
        asked = list(dict.fromkeys(ids))
        rows = self.spark.createDataFrame([(i,) for i in asked], "doc_id string")
        return F.broadcast(rows) if len(asked) <= BROADCAST_IDS and sum(map(len, asked)) <= BROADCAST_CHARS else rows

    @property
    def document_ids(self) -> list[str]:
        return [r[0] for r in self.index().select("doc_id").orderBy("doc_id").collect()]

    def __contains__(self, document_id: object) -> bool:
        return isinstance(document_id, str) and bool(self.document_lengths([document_id]))

    def document_lengths(self, ids: Iterable[str]) -> dict[str, int]:
        """Token counts of the ids that are present."""
        asked = document_ids(ids)
        if not asked:
            return {}
        found = dict(self.present(self._ids(asked)).select("doc_id", "token_count").collect())
        return {i: found[i] for i in asked if i in found}

    def fetch(self, ids: Iterable[str], *, threads: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Float32 tokens of the documents in the order asked for, repeats included, and their lengths."""
        asked, dim = document_ids(ids), self.manifest.representation.dimension
        if threads is not None and threads <= 0:
            raise ValueError("threads must be positive")
        if not asked:
            return np.zeros((0, dim), np.float32), np.zeros(0, np.int64)
        table = self.present(self._ids(asked)).toArrow()
        at = {d: i for i, d in enumerate(table.column("doc_id").to_pylist())}
        if missing := [i for i in asked if i not in at]:
            raise ValueError(f"documents {missing[:5]} are not in the vector store")
        rows = [at[i] for i in asked]
        taken = table.take(pa.array(rows)).combine_chunks()
        lengths = taken.column("token_count").to_numpy().astype(np.int64)
        return decode(taken, self.manifest.encoding, self.manifest.representation), lengths


def decode(table: pa.Table, encoding: str, representation: Representation) -> np.ndarray:
    """The float32 token matrix of rows of a segment."""

    def flat(name: str) -> np.ndarray:
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]
        return np.concatenate(parts) if parts else np.zeros(0)

    dim = representation.dimension
    if encoding == "float32":
        return flat("vectors").astype(np.float32).reshape(-1, dim)
    out = flat("codes").astype(np.float32).reshape(-1, dim) * flat("scales").astype(np.float32)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-12)) if representation.normalized else out


class VectorStore:
    """Reader of a store; every ``view`` follows the latest commit."""

    def __init__(self, path: str | Path, spark: SparkSession | None = None) -> None:
        self.spark, self.path = _spark(spark), Path(path)
        self._at = str(path).rstrip("/")
        self._view = StoreView(self.spark, self._at, self._manifest())

    def _manifest(self) -> Manifest:
        return Manifest.from_json(files.read_text(self.spark, f"{self._at}/manifest.json"))

    @property
    def corpus(self) -> str:
        return self._view.manifest.corpus

    @property
    def encoding(self) -> Literal["float32", "int8"]:
        return self._view.manifest.encoding

    @property
    def score_semantics(self) -> str:
        return SEMANTICS[self.encoding]

    @property
    def representation(self) -> Representation:
        return self._view.manifest.representation

    @property
    def dimension(self) -> int:
        return self.representation.dimension

    def view(self) -> StoreView:
        """The current commit; the same object while there is no newer one."""
        now, had = self._manifest(), self._view.manifest
        if now == had:
            return self._view
        if (now.corpus, now.encoding, now.representation) != (had.corpus, had.encoding, had.representation):
            raise ValueError("the store was replaced by one of another corpus, encoding or representation")
        if now.store_id == had.store_id:
            known = {s[0]: s for s in had.segments}
            if any(known.get(s[0], s) != s for s in now.segments):
                raise ValueError("a segment that was known has other counts now")
        self._view = StoreView(self.spark, self._at, now)
        return self._view

    def read(self, use: Callable[[StoreView], T]) -> T:
        """What ``use`` makes of the current view; planned again on a newer commit if files of this one are gone.

        Only a missing file is a reason, and only if there is a newer commit:
        else the store is damaged.
        """
        for attempt in range(1, ATTEMPTS + 1):
            view = self.view()
            try:
                return use(view)
            except Exception as error:
                if attempt == ATTEMPTS or not files.vanished(error) or self._manifest() == view.manifest:
                    raise
        raise AssertionError


class VectorStoreWriter:
    """The one writer of a store. What it stages is visible after ``commit``."""

    def __init__(self, path: str | Path, spark: SparkSession | None = None) -> None:
        self.spark, self._at = _spark(spark), str(path).rstrip("/")
        self.manifest = self._staged = Manifest.from_json(files.read_text(self.spark, f"{self._at}/manifest.json"))
        self._recover()

    @classmethod
    def create(cls, path: str | Path, corpus: str, representation: Representation, *, encoding: str = "float32", spark: SparkSession | None = None) -> VectorStoreWriter:
        spark, at = _spark(spark), str(path).rstrip("/")
        if encoding not in SEMANTICS:
            raise ValueError(f"encoding must be one of {sorted(SEMANTICS)}")
        if not corpus:
            raise ValueError("corpus must not be empty")
        if files.exists(spark, at):
            raise FileExistsError(at)
        files.make_dir(spark, at)
        first = Manifest(secrets.token_hex(16), encoding, corpus, representation, 0, 0, time.time(), (), ())
        files.publish_text(spark, f"{at}/manifest.json", first.to_json())
        return cls(at, spark)

    @property
    def corpus(self) -> str:
        return self.manifest.corpus

    def _recover(self) -> None:
        """Remove what an earlier writer staged and never committed."""
        for name in files.names(self.spark, self._at):
            found = re.fullmatch(r"(segment|tombstones)-(\d+)", name)
            if name.endswith(".tmp") or found and int(found[2]) >= self.manifest.next_id:
                files.remove(self.spark, f"{self._at}/{name}")

    def _take_id(self) -> int:
        own = self._staged.next_id
        if own >= _MAX_ID:
            raise ValueError("the store has no ids left")
        self._staged = replace(self._staged, next_id=own + 1)
        return own

    def append(self, document_ids_: Iterable[str], embeddings: np.ndarray, document_lengths: np.ndarray | Sequence[int], *, threads: int | None = None) -> None:
        """Stage documents, new or in place of those with their ids; nothing happens without any."""
        ids = document_ids(document_ids_)
        packed, lengths = check_packed(np.asarray(embeddings), np.asarray(document_lengths, dtype=np.int64 if not len(document_lengths) else None), None)
        dim = self.manifest.representation.dimension
        if len(ids) != len(lengths):
            raise ValueError(f"{len(ids)} documents, but {len(lengths)} lengths")
        if len(set(ids)) != len(ids):
            raise ValueError("a document is given more than once")
        if packed.shape[1] != dim:
            raise ValueError(f"embeddings have dimension {packed.shape[1]}; the store has {dim}")
        if not ids:
            return
        if not np.isfinite(packed).all():
            raise ValueError("embeddings must be finite")
        if self.manifest.representation.normalized and np.abs(np.linalg.norm(packed.astype(np.float64), axis=1) - 1).max() > UNIT_TOLERANCE:
            raise ValueError("the representation is normalized, but a vector is not of unit length")
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))) * dim, pa.int32() if packed.size < 2**31 else pa.int64())
        kind = pa.ListArray if packed.size < 2**31 else pa.LargeListArray
        vectors = kind.from_arrays(offsets, pa.array(packed.reshape(-1)))
        table = pa.table({"doc_id": pa.array(ids, pa.string()), "token_count": pa.array(lengths, pa.int32()), "vectors": vectors})
        self._stage(self.spark.createDataFrame(table))

    def append_frame(self, documents: DataFrame) -> None:
        """Stage ``documents(doc_id, token_count, vectors array<float>)``, checked in one aggregation."""
        dim, unit = self.manifest.representation.dimension, F.lit(True)
        rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("token_count").cast("int").alias("token_count"), F.col("vectors").cast("array<float>").alias("vectors"))
        if self.manifest.representation.normalized:
            unit = F.forall(_tokens(dim), lambda t: F.abs(F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) - 1) <= UNIT_TOLERANCE)
        layout = F.coalesce((F.col("token_count") > 0) & (F.size("vectors") == F.col("token_count") * dim) & F.col("doc_id").isNotNull(), F.lit(False))
        checked = rows.agg(
            F.count("*").alias("n"),
            F.count_distinct("doc_id").alias("ids"),
            F.count_if(~layout).alias("layout"),
            F.count_if(layout & ~all_finite(F.col("vectors"))).alias("finite"),
            F.count_if(layout & all_finite(F.col("vectors")) & ~unit).alias("unit"),
        ).first()
        for what, text in (("layout", "documents lack an id, tokens, or token_count times dimension values"), ("finite", "documents hold values that are not finite"), ("unit", "documents hold vectors that are not of unit length, but the representation is normalized")):
            if checked[what]:
                raise ValueError(f"{checked[what]} {text}")
        if checked["ids"] != checked["n"]:
            raise ValueError("a document is given more than once")
        if checked["n"]:
            self._stage(rows)

    def _stage(self, rows: DataFrame) -> None:
        own, dim = self._take_id(), self.manifest.representation.dimension
        placed = rows.select(F.lit(own).cast("long").alias("segment_id"), F.monotonically_increasing_id().alias("row"), "doc_id", "token_count", "vectors")
        if self.manifest.encoding == "int8":
            placed = placed.withColumn("__t", _tokens(dim)).withColumn("scales", F.transform("__t", int8_scale))
            placed = placed.withColumn("codes", F.flatten(F.zip_with("__t", "scales", int8_codes))).select("segment_id", "row", "doc_id", "token_count", "codes", "scales")
        self._write(placed, own)

    def _write(self, placed: DataFrame, own: int) -> None:
        at = f"{self._at}/segment-{own}"
        placed.write.parquet(at)
        try:
            n, tokens = self._checked(at, own)
        except Exception:
            files.remove(self.spark, at)
            raise
        self._staged = replace(self._staged, segments=(*self._staged.segments, (own, n, tokens)))

    def _checked(self, at: str, own: int) -> tuple[int, int]:
        """Documents and tokens of a written segment, or a ValueError if it doesn't read back as one."""
        dim = self.manifest.representation.dimension
        if self.manifest.encoding == "int8":
            values = (F.size("codes") == F.col("token_count") * dim) & (F.size("scales") == F.col("token_count")) & all_finite(F.col("scales")) & F.forall("scales", lambda x: x > 0)
        else:
            values = (F.size("vectors") == F.col("token_count") * dim) & all_finite(F.col("vectors"))
        whole = (F.col("segment_id") == own) & (F.col("row") >= 0) & F.col("doc_id").isNotNull() & (F.col("token_count") > 0) & values
        found = self.spark.read.schema(segment_schema(self.manifest.encoding)).parquet(at).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("row").alias("rows"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken")
        ).first()
        if found["broken"] or found["ids"] != found["n"] or found["rows"] != found["n"]:
            raise ValueError(f"the segment written to {at} doesn't read back whole: {found.asDict()}")
        return int(found["n"]), int(found["tokens"])

    def delete(self, ids: Iterable[str]) -> int:
        """Stage the removal of present documents, staged ones included; returns how many there were."""
        asked = document_ids(ids)
        return self.delete_frame(self.spark.createDataFrame([(i,) for i in asked], "doc_id string")) if asked else 0

    def delete_frame(self, ids: DataFrame) -> int:
        rows, gone = _read(self.spark, self._at, self._staged)
        held = rows.select("doc_id", "segment_id", "row").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        own = self._take_id()
        at = f"{self._at}/tombstones-{own}"
        present_rows(held, gone).select("segment_id", "row").write.parquet(at)
        n = self.spark.read.schema("segment_id long, row long").parquet(at).count()
        if n:
            self._staged = replace(self._staged, tombstones=(*self._staged.tombstones, own))
        else:
            files.remove(self.spark, at)
        return n

    def compact(self) -> None:
        """Stage one segment of the present documents, in segment and row order, in place of all."""
        if len(self._staged.segments) <= 1 and not self._staged.tombstones:
            return
        view = StoreView(self.spark, self._at, self._staged)
        live = view.present()
        own = self._take_id()
        ordered = live.orderBy("segment_id", "row").withColumn("row", F.monotonically_increasing_id()).withColumn("segment_id", F.lit(own).cast("long"))
        before = self._staged
        self._staged = replace(before, segments=(), tombstones=())
        try:
            self._write(ordered.select(view.rows.columns), own)
        except Exception:
            self._staged = replace(before, next_id=own + 1)
            raise
        if not self._staged.segments[-1][1]:
            self._staged = replace(self._staged, segments=())
            files.remove(self.spark, f"{self._at}/segment-{own}")

    def commit(self) -> datetime:
        """Publish what is staged, or only that the store is current; returns the time of the commit."""
        if self.manifest.commit >= _MAX_ID:
            raise ValueError("the store has no commit numbers left")
        now = max(time.time(), self.manifest.committed_at)
        new = replace(self._staged, commit=self.manifest.commit + 1, committed_at=now)
        files.publish_text(self.spark, f"{self._at}/manifest.json", new.to_json())
        self.manifest = self._staged = new
        return datetime.fromtimestamp(now, timezone.utc)

    def vacuum(self, retain_seconds: float = 86_400.0) -> list[str]:
        """Remove tables that the committed manifest doesn't name, once it is ``retain_seconds`` old.

        Queries over older views must have ended by then. Returns the names.
        """
        if time.time() - self.manifest.committed_at < retain_seconds or self._staged != self.manifest:
            return []
        named = {f"segment-{s[0]}" for s in self.manifest.segments} | {f"tombstones-{t}" for t in self.manifest.tombstones}
        gone = [n for n in files.names(self.spark, self._at) if re.fullmatch(r"(segment|tombstones)-\d+", n) and n not in named]
        for name in gone:
            files.remove(self.spark, f"{self._at}/{name}")
        return gone


def _tokens(dim: int):
    """The flat array ``vectors`` as an array of tokens; an empty one for none."""
    return F.transform(F.when(F.col("token_count") > 0, F.sequence(F.lit(0), F.col("token_count") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(F.col("vectors"), i * dim + 1, dim))
