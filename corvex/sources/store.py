"""The index as Parquet tables, published by numbered manifests.

A commit writes its batch of postings, weights and statistics to new folders and then publishes the next manifest,
which lists the folders that count. Readers take the newest manifest, so they see a commit whole or not at all;
a removed document is a row in a tombstone folder. Postings are partitioned by field and are in runs sorted by term, so
that a search reads the pages of its terms alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.config import SCHEMA_VERSION, GeneralError, IndexConfig
from corvex.operators.build import DOCS, POSTINGS, STATS, WEIGHTS, Tables, resorted
from corvex.sources.files import Files

TOMBSTONES = "doc_id long"
MASK = "doc_id long"
#: Ids of a chunk, as bits: the postings of a term in one chunk are in one file.
CHUNK_BITS = 20
#: Ids that each executor may hold in memory; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


@dataclass(frozen=True)
class Manifest:
    version: int
    config: str
    max_id: int = 0
    batches: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    masks: dict = field(default_factory=dict)
    averages: dict = field(default_factory=dict)
    #: Of each field, the weights of live documents in all; of each batch, its documents.
    sums: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    schema: int = SCHEMA_VERSION


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # --- manifests ---

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.children(f"{self.path}/manifests") if n.endswith(".json") and n[0] == "v")

    def exists(self) -> bool:
        return bool(self._versions())

    def version(self) -> int:
        return (self._versions() or [0])[-1]

    def manifest(self) -> Manifest:
        if not (n := self.version()):
            raise GeneralError(f"there is no index at {self.path}")
        found = json.loads(self.files.read(f"{self.path}/manifests/v{n:012d}.json"))
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def publish(self, m: Manifest, **changes) -> Manifest:
        m = replace(m, version=m.version + 1, **changes)
        if not self.files.write_new(f"{self.path}/manifests/v{m.version:012d}.json", json.dumps(m.__dict__)):
            raise GeneralError("another writer has changed the index meanwhile", detail=f"version {m.version}")
        return m

    def config(self) -> IndexConfig:
        return IndexConfig.from_json(self.manifest().config)

    # --- life of the whole ---

    def create(self, config: IndexConfig) -> None:
        """Drops what is there, and makes an empty index."""
        self.drop()
        self.publish(Manifest(0, config.to_json()))

    def drop(self) -> None:
        self.files.delete(self.path)

    def fork(self, path: str) -> Store:
        """A new index at path that starts as this one does now; it shares the folders that are there already."""
        out = Store(self.spark, path)
        out.publish(Manifest(**{**self.manifest().__dict__, "version": 0}))
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last ``keep`` and the folders that none of these lists; returns how many folders.

        Readers of older versions, forks and writers at work lose what they share with this index.
        """
        versions = self._versions()
        used: set[str] = set()
        for n in versions[-keep:]:
            m = json.loads(self.files.read(f"{self.path}/manifests/v{n:012d}.json"))
            used |= {*m["batches"], *m["tombstones"], *m["masks"].values()}
        for n in versions[:-keep]:
            self.files.delete(f"{self.path}/manifests/v{n:012d}.json")
        old = [f for kind in ("batches", "tombstones", "masks") for name in self.files.children(f"{self.path}/{kind}") if (f := f"{self.path}/{kind}/{name}") not in used]
        for f in old:
            self.files.delete(f)
        self.clear_staging()
        return len(old)

    # --- tables ---

    def folder(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def clear_staging(self) -> None:
        """Removes what commits wrote on the way; what a lost writer left goes with it."""
        self.files.delete(f"{self.path}/staging")

    def _read(self, schema, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _union(self, schema, folders: list[str]) -> DataFrame:
        """Folders partitioned by field: each is a table of its own."""
        out = None
        for f in folders:
            part = self.spark.read.schema(schema).parquet(f).select(*schema.fieldNames())
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def all_docs(self, m: Manifest) -> DataFrame:
        return self._read(DOCS, [f"{b}/docs" for b in m.batches])

    def dead(self, m: Manifest) -> DataFrame:
        return self._read(TOMBSTONES, list(m.tombstones))

    def live(self, m: Manifest) -> DataFrame:
        docs = self.all_docs(m)
        return docs.join(self.dead(m), "doc_id", "left_anti") if m.tombstones else docs

    def postings(self, m: Manifest) -> DataFrame:
        return self._union(POSTINGS, [f"{b}/postings" for b in m.batches])

    def doc_weights(self, m: Manifest) -> DataFrame:
        return self._union(WEIGHTS, [f"{b}/weights" for b in m.batches])

    def term_stats(self, m: Manifest) -> DataFrame:
        found = self._union(STATS, [f"{b}/stats" for b in m.batches])
        return found if len(m.batches) < 2 else found.groupBy("field", "term").agg(F.sum("df").alias("df"))

    def mask(self, m: Manifest, name: str) -> DataFrame | None:
        return self._read(MASK, [m.masks[name]]) if name in m.masks else None

    def tables(self, m: Manifest) -> Tables:
        return Tables(IndexConfig.from_json(m.config), self.live(m), self.postings(m), self.term_stats(m), self.doc_weights(m), m.averages, m.max_id)

    def write_batch(self, docs: DataFrame, posted: dict[str, DataFrame], weights: DataFrame) -> tuple[str, int, dict[str, float]]:
        """Writes the tables of documents; they count once a manifest lists the folder. posted: the postings of each field.

        Returns the folder, its number of documents and the sum of weights of each field.
        """
        b = self.folder("batches")
        docs.write.parquet(f"{b}/docs")
        weights.write.partitionBy("field").parquet(f"{b}/weights")
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for name, rows in posted.items():  # a folder each, so that Spark doesn't sort the rows by field
            rows.write.parquet(f"{b}/postings/field={names.escapePathName(name)}")
        written = self.spark.read.schema(POSTINGS).parquet(f"{b}/postings")
        stats = written.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        stats.sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{b}/stats")
        return b, self.spark.read.schema(DOCS).parquet(f"{b}/docs").count(), self._sums(self._union(WEIGHTS, [f"{b}/weights"]))

    def rewritten(self, m: Manifest, dead: DataFrame | None = None) -> tuple[str, int, dict[str, float]]:
        """Writes the batches of m as one, without dead documents.

        Each task reads a part of the files and writes it in longer runs. Only where the files are too few for the
        cores, postings are dealt by term and chunk of ids first, so that no task has more than a chunk of a term.
        """
        if dead is not None and dead.count() <= BROADCAST_IDS:
            dead = F.broadcast(dead)
        keep = lambda df: df if dead is None else df.join(dead, "doc_id", "left_anti")
        cores = min(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        posted = {}
        for name in IndexConfig.from_json(m.config).doc_fields:
            found = self.postings(m).filter(F.col("field") == name)
            few = found.rdd.getNumPartitions() < cores
            found = keep(found)
            posted[name] = resorted(found.repartition("term", F.shiftright("doc_id", CHUNK_BITS)) if few else found)
        return self.write_batch(keep(self.all_docs(m)).select(*DOCS.fieldNames()), posted, keep(self.doc_weights(m)).select(*WEIGHTS.fieldNames()))

    def _sums(self, weights: DataFrame) -> dict[str, float]:
        return {r["field"]: r["s"] for r in weights.groupBy("field").agg(F.sum("w_d").alias("s")).collect()}

    def sums_of(self, m: Manifest, ids: DataFrame) -> dict[str, float]:
        """Of each field, the weights of these documents."""
        return self._sums(self.doc_weights(m).join(ids, "doc_id", "left_semi"))

    def live_sums(self, m: Manifest) -> dict[str, float]:
        """Of each field, the weights of live documents, which the manifest has unless it is an old one."""
        if m.sums or not m.batches:
            return m.sums
        w = self.doc_weights(m)
        return self._sums(w.join(self.dead(m), "doc_id", "left_anti") if m.tombstones else w)

    def merged(self, m: Manifest, most: int) -> Manifest:
        """m with its smallest batches in one, if there are more than ``most``.

        Removed documents stay in the statistics, as they do until the index is optimized. Half of the batches are merged
        at a time, so that a document is written anew a logarithmic number of times.
        """
        if len(m.batches) <= most:
            return m
        some = sorted(m.batches, key=lambda b: m.sizes.get(b, 1 << 62))[: max(2, most // 2 + 1)]
        part = replace(m, batches=tuple(some))
        b, n, _ = self.rewritten(part)
        kept = [x for x in m.batches if x not in some]
        return replace(m, batches=(*kept, b), sizes={**{x: m.sizes[x] for x in kept if x in m.sizes}, b: n})
