"""The public face of the engine: an index of the text columns of a table, and searches on it."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.config import GeneralError, IndexConfig, QueryError
from corvex.functions.highlight import highlight
from corvex.operators import build
from corvex.operators.search import of_pairs, search, top
from corvex.plans.planner import plan
from corvex.sources.files import Files
from corvex.sources.loaders import numbered
from corvex.sources.store import Manifest, Store

log = logging.getLogger(__name__)
MASK_KINDS = ("and_mask", "or_mask", "not_mask")


def _less(sums: dict[str, float], gone: dict[str, float]) -> dict[str, float]:
    return {f: s - gone.get(f, 0.0) for f, s in sums.items()}


class SearchIndex:
    """An index at a path. With a config it may be new; without one it must exist, and what it stored counts."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self._pending: list[DataFrame] | None = None
        self._pending_rows = 0
        self._source: DataFrame | None = None
        self._cached: tuple[int, build.Tables] | None = None
        self.last_plan = None
        if self.store.exists():
            self.config = self.store.config()
        elif config is None:
            raise GeneralError(f"there is no index at {path}, and no config for a new one")
        else:
            self.config = config

    # --- the whole ---

    def initialize(self) -> SearchIndex:
        """Makes an empty index, dropping any that is there."""
        self.store.create(self.config)
        return self

    def delete(self) -> None:
        self.store.drop()

    def exists(self) -> bool:
        return self.store.exists()

    def manifest(self) -> Manifest:
        return self.store.manifest()

    def tables(self) -> build.Tables:
        """The tables of the newest version, which another writer may have published."""
        m = self.store.manifest()
        if not self._cached or self._cached[0] != m.version:
            self.flush_cache()
            self._cached = (m.version, self.store.tables(m))
        return self._cached[1]

    # --- adding ---

    def set_source(self, source: DataFrame) -> None:
        """The table that documents are added from by key, and that phrases are looked up in without positions."""
        self._source = source

    def add_doc(self, *keys, source: DataFrame | None = None) -> int:
        """Adds rows of the source by their keys; missing ones are skipped. Returns how many were added."""
        source = source if source is not None else self._source
        if source is None:
            raise GeneralError("there is no source to add from")
        wanted = [k for key in keys for k in (key if isinstance(key, (list, tuple, set)) else [key])]
        ids = self.spark.createDataFrame([(str(k),) for k in dict.fromkeys(wanted)], "k string")
        return self.add_table(source.join(ids, F.col(self.config.key).cast("string") == F.col("k"), "left_semi"))

    add_document = add_doc

    def add(self, documents: DataFrame | dict[str, dict[str, str]]) -> int:
        """Adds documents: a DataFrame of the key and the fields, or key to field to text."""
        if isinstance(documents, DataFrame):
            return self.add_table(documents)
        rows = [(str(k), *(v.get(f) for f in self.config.doc_fields)) for k, v in documents.items()]
        schema = ", ".join([f"`{self.config.key}` string", *(f"`{f}` string" for f in self.config.doc_fields)])
        return self.add_table(self.spark.createDataFrame(rows, schema))

    def add_table(self, docs: DataFrame) -> int:
        """Adds all rows. A key that is there already is replaced, and gets a new id; of equal keys the last counts."""
        rows = docs.select(F.col(self.config.key).alias("_key"), *(F.col(f).cast("string").alias(f) for f in self.config.doc_fields)).filter("_key is not null")
        if self._pending is None:
            return self._commit([rows])
        folder = self.store.folder("staging")  # what is added now counts, whatever becomes of the source
        rows.write.parquet(folder)
        rows = self.spark.read.schema(rows.schema).parquet(folder)
        n = rows.count()
        self._pending.append(rows)
        self._pending_rows += n
        if self._pending_rows >= self.config.update_commit_interval:
            self._flush()
        return n

    def begin_add(self) -> SearchIndex:
        self._pending, self._pending_rows = [], 0
        return self

    def commit_add(self) -> int:
        n = self._flush()
        self._pending = None
        return n

    def __enter__(self) -> SearchIndex:
        return self.begin_add()

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit_add()
        self._pending = None

    def _flush(self) -> int:
        n = self._commit(self._pending) if self._pending else 0
        if self._pending is not None:
            self._pending, self._pending_rows = [], 0
        return n

    def _commit(self, parts: list[DataFrame]) -> int:
        """Writes a batch: the terms of numbered documents first, from which all tables are made.

        Texts are shuffled once, by ranges of their keys, in which equal keys meet and get their order.
        """
        m, store = self.store.manifest(), self.store
        rows = None
        for i, part in enumerate(parts):
            part = part.withColumn("_seq", F.struct(F.lit(i), F.monotonically_increasing_id()))
            rows = part if rows is None else rows.unionByName(part)
        fields = list(self.config.doc_fields)
        last = rows.repartitionByRange("_key").groupBy("_key").agg(F.max_by(F.struct(*fields), "_seq").alias("d")).select("_key", *(F.col("d")[f].alias(f) for f in fields))
        docs = numbered(last, ["_key"], "doc_id", m.max_id, store.folder("staging"), dealt=True, then=lambda rows: build.staged(rows, self.config)).withColumn("doc_key", F.col("_key").cast("string"))
        found = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
        if not found["n"]:
            store.clear_staging()
            return 0
        graves, sums = m.tombstones, dict(store.live_sums(m))
        if m.batches:
            grave = store.folder("tombstones")
            store.live(m).join(docs.select("doc_key"), "doc_key", "left_semi").select("doc_id").write.parquet(grave)
            old = self.spark.read.schema("doc_id long").parquet(grave)
            if not old.isEmpty():
                graves = (*graves, grave)
                sums = _less(sums, store.sums_of(m, old))
        batch, n, own = store.write_batch(docs.select("doc_id", "doc_key"), build.postings(docs, self.config), build.weights(docs, self.config))
        sums = {f: sums.get(f, 0.0) + own.get(f, 0.0) for f in {*sums, *own}}
        averages = {f: s / found["top"] for f, s in sums.items()}
        new = Manifest(**{**m.__dict__, "max_id": found["top"], "batches": (*m.batches, batch), "tombstones": graves, "averages": averages, "sums": sums, "sizes": {**m.sizes, batch: n}})
        new = store.merged(new, self.config.max_batches)
        store.publish(m, **{k: v for k, v in new.__dict__.items() if k != "version"})
        store.clear_staging()
        log.info("added %d documents to %s", n, self.config.collection)
        return n

    # --- removing ---

    def remove(self, *keys) -> int:
        """Removes documents by their keys; returns how many there were. Statistics keep them until optimize."""
        wanted = [str(k) for key in keys for k in (key if isinstance(key, (list, tuple, set)) else [key])]
        return self.remove_table(self.spark.createDataFrame([(k,) for k in wanted], "doc_key string"))

    remove_doc = remove_document = remove

    def remove_table(self, keys: DataFrame, key: str = "doc_key") -> int:
        m = self.store.manifest()
        grave = self.store.folder("tombstones")
        own = keys.select(F.col(key).cast("string").alias("doc_key"))
        self.store.live(m).join(own, "doc_key", "left_semi").select("doc_id").write.parquet(grave)
        dead = self.spark.read.schema("doc_id long").parquet(grave)
        n = dead.count()
        if n:
            self.store.publish(m, tombstones=(*m.tombstones, grave), sums=_less(self.store.live_sums(m), self.store.sums_of(m, dead)))
        return n

    def optimize(self) -> None:
        """Rewrites all batches as one, of live documents alone; statistics forget the removed. Ids stay."""
        m = self.store.manifest()
        batch, n, sums = self.store.rewritten(m, dead=self.store.dead(m) if m.tombstones else None)
        averages = {f: s / m.max_id for f, s in sums.items()} if m.max_id else {}
        self.store.publish(m, batches=(batch,), tombstones=(), averages=averages, sums=sums, sizes={batch: n})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what no longer belongs to the last ``keep`` versions; see the store."""
        self.flush_cache()
        return self.store.vacuum(keep)

    # --- looking up ---

    def indexed(self, key) -> int | None:
        """The id of a key, or None."""
        row = self.tables().docs.filter(F.col("doc_key") == str(key)).agg(F.max("doc_id").alias("i")).first()
        return row["i"]

    def max_indexed_id(self) -> int:
        return self.store.manifest().max_id

    def last_indexed_key(self) -> str | None:
        """The key of the highest id; None if that document was removed."""
        t = self.tables()
        row = t.docs.filter(F.col("doc_id") == t.max_id).first()
        return row["doc_key"] if row else None

    def all_doc_ids(self) -> DataFrame:
        return self.tables().docs.orderBy("doc_id")

    def doc_keys(self, ids: DataFrame) -> DataFrame:
        return ids.select("doc_id").join(self.tables().docs, "doc_id").orderBy("doc_id")

    def doc_ids(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.col("doc_key").cast("string").alias("doc_key")).join(self.tables().docs, "doc_key").orderBy("doc_id")

    def fetch(self, key, field: str) -> str | None:
        """One field of the source's row of a key, or None."""
        if self._source is None:
            raise GeneralError("there is no source to fetch from")
        if field not in self.config.doc_fields:
            raise GeneralError(f"there is no field {field}")
        row = self._source.filter(F.col(self.config.key).cast("string") == str(key)).select(F.col(field).cast("string").alias("v")).first()
        return row["v"] if row else None

    def warm(self, query: dict[str, str]) -> int:
        """Holds the postings of a query's terms in the executors' memory, or on their disks, for later searches.

        Only searches whose terms are all held use them. Returns how many postings there are. They are forgotten with
        the version that they belong to, and by ``flush_cache``.
        """
        t = self.tables()
        pairs = plan(query, self.config, t.term_stats).needed()
        old = t.hot
        pairs |= old[0] if old else set()
        rows = of_pairs(t.postings, pairs).persist()
        n = rows.count()
        t.hot = (frozenset(pairs), rows)
        if old:
            old[1].unpersist()
        return n

    def flush_cache(self) -> None:
        if self._cached and self._cached[1].hot:
            self._cached[1].hot[1].unpersist()
        self._cached = None

    def stat(self, name: str) -> int | None:
        """total_words: the sum of document frequencies over all fields. Other names: None."""
        if name != "total_words":
            return None
        return self.tables().term_stats.agg(F.sum("df").alias("s")).first()["s"] or 0

    # --- masks ---

    def add_mask(self, name: str, keys: DataFrame | Iterable) -> int:
        """Names a set of documents, replacing one of that name; keys that aren't indexed are dropped."""
        if not name or len(name) > 100:
            raise GeneralError("a mask's name has 1 to 100 characters")
        m = self.store.manifest()
        folder = self.store.folder("masks")
        self._ids(keys).write.parquet(folder)
        self.store.publish(m, masks={**m.masks, name: folder})
        return self.spark.read.schema("doc_id long").parquet(folder).count()

    def delete_mask(self, name: str) -> bool:
        m = self.store.manifest()
        if name not in m.masks:
            return False
        self.store.publish(m, masks={k: v for k, v in m.masks.items() if k != name})
        return True

    def _ids(self, keys: DataFrame | Iterable) -> DataFrame:
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(str(k),) for k in keys], "doc_key string")
        first = keys.columns[0] if "doc_key" not in keys.columns else "doc_key"
        own = keys.select(F.col(first).cast("string").alias("doc_key"))
        return self.tables().docs.join(own, "doc_key", "left_semi").select("doc_id")

    def _masks(self, args: dict) -> list[tuple[DataFrame, bool]]:
        m = self.store.manifest()

        def one(x) -> DataFrame | None:
            return self.store.mask(m, x) if isinstance(x, str) else self._ids(x)

        out = [(x, True) for name in args.get("and_mask") or () if (x := one(name)) is not None]
        out += [(x, False) for name in args.get("not_mask") or () if (x := one(name)) is not None]
        sets = list(args.get("or_mask_set") or ())
        if args.get("or_mask"):
            sets.append(args["or_mask"])
        for group in sets:
            some = [x for name in group if (x := one(name)) is not None]
            if some:
                union = some[0]
                for x in some[1:]:
                    union = union.unionByName(x)
                out.append((union, True))
        return out

    # --- searching ---

    def find(self, query: dict[str, str], *, scored: bool = True, k: int | None = None, **masks) -> DataFrame:
        """The result as a DataFrame, which may be empty: doc_id, doc_key, and score if scored.

        Only document frequencies are looked up now, and with a ``phrase_threshold`` the candidates of phrases counted.
        """
        if unknown := set(masks) - {*MASK_KINDS, "or_mask_set", "scoring_method"}:
            raise GeneralError(f"unknown arguments: {', '.join(sorted(unknown))}")
        method = masks.get("scoring_method") or self.config.scoring_method
        if scored and method != "okapi":
            raise GeneralError(f"there is no scoring method {method}; there is okapi")
        source = None
        if not self.config.proximity_index and self._source is not None:
            source = self._source.select(F.col(self.config.key).cast("string").alias("doc_key"), *self.config.doc_fields)
        found, self.last_plan = search(self.tables(), query, masks=self._masks(masks), scored=scored, source=source)
        return top(found, k) if k is not None and scored else found

    def _raise_if_none(self, found) -> None:
        if not found:
            stopped = self.last_plan.stopped
            raise QueryError(f"{self.config.message('no_results_stop')} {', '.join(stopped)}." if stopped else self.config.message("no_results"))

    def search(self, query: dict[str, str] | None, *, k: int | None = None, **masks) -> dict[str, float]:
        """Key to score of all matching documents or the k best, best first; a QueryError if there is none."""
        if not query:
            raise QueryError(self.config.message("empty_query"))
        rows = self.find(query, k=k, **masks)
        if k is None:
            rows = rows.orderBy(F.desc("score"), "doc_key")
        found = {r["doc_key"]: r["score"] for r in rows.toLocalIterator()}
        self._raise_if_none(found)
        return found

    def unscored_search(self, query: dict[str, str] | None, **masks) -> list[str]:
        """The keys of all matching documents in the order of their ids; a QueryError if there is none."""
        if not query:
            raise QueryError(self.config.message("empty_query"))
        found = [r["doc_key"] for r in self.find(query, scored=False, **masks).orderBy("doc_id").toLocalIterator()]
        self._raise_if_none(found)
        return found

    def query_words(self) -> list[str]:
        """The words of the last query."""
        return sorted({t for leaf in self.last_plan.leaves for t in leaf.terms}) if self.last_plan else []

    def html_highlight(self, docs: DataFrame, field: str, before: str = "<b><u>", after: str = "</u></b>") -> DataFrame:
        """docs with the words of the last query marked in a field."""
        return docs.withColumn(field, highlight(F.col(field), self.query_words(), before, after))


def collections(spark: SparkSession, root: str) -> list[str]:
    """The names of the indexes below a folder."""
    files = Files(spark, root)
    return [n for n in files.children(root) if files.exists(f"{root}/{n}/manifests")]


def collection_count(spark: SparkSession, root: str) -> int:
    return len(collections(spark, root))
