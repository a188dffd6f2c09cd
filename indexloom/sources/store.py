"""The stored index: a log of commits and the immutable batches of rows that it names.

`embeddings` and `chunks` are folders of batches. A batch is written once, into a folder of its own, and is never changed:
first the rows a collection begins with (a base), then what each upsert brings (a delta, with a tombstone for each removed
id). A commit is one small file in `log`; batches of both tables enter the index with it together, and a job that fails
before leaves nothing that a reader sees. So an upsert writes about as many bytes as it is given, whatever the index holds.

Readers merge: the last version of each id in the deltas stands before the base. `compact` folds the deltas into a new base,
and `vacuum` empties the folders of batches that no commit names any more.

Batches are ranges of their sort key, cut by size: chunks by path, embeddings by type and id. Footers hold Bloom filters
of id and path, so that lookups and filters skip files, row groups and pages.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom import schemas
from indexloom.errors import CollectionExists, CollectionNotFound, IndexNotFound, ModelMismatch
from indexloom.functions.text import human_size
from indexloom.operators.packed import in_ranges
from indexloom.operators.upsert import latest
from indexloom.session import written

MAX_LITERAL_KEYS = 1000  # keys a lookup turns into literals
FILE_BYTES = 128 * 1024 * 1024  # of a batch in one file
FINISH_BYTES = 1024 * 1024  # of rows that are worth a task of their own where they are finished as they are stored
ROW_BYTES = 100  # of a row beside its id, text and vector, as it is sorted
ROW_GROUP_BYTES = 16 * 1024 * 1024
BROADCAST_ID_BYTES = 32 * 1024 * 1024  # of changed ids that readers broadcast; more are joined

SORT_KEYS = {"embeddings": ["type", "id"], "chunks": ["path", "start_line", "id"], "outline": ["first"]}
BLOOM_KEYS = {"embeddings": ["id", "path"], "chunks": ["id", "path"], "outline": ["id", "path"]}

_LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("action", T.StringType()),  # reset, create, add or remove
        T.StructField("table", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("kind", T.StringType()),  # base, delta or outline
        T.StructField("rows", T.LongType()),
        T.StructField("id_bytes", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("updated", T.TimestampType()),
    ]
)
Finish = dict[str, Callable[[DataFrame], DataFrame]]  # by table
_VERSION, _GONE = T.StructField("version", T.LongType()), T.StructField("gone", T.BooleanType())


@dataclass(frozen=True)
class Batch:
    """What the log says of a batch of one collection."""

    table: str
    collection: str
    batch: str
    kind: str
    rows: int
    id_bytes: int
    bytes: int
    version: int


@dataclass(frozen=True)
class _Rows:
    """What a batch is made of: rows, what adds the columns they lack (vectors of `dim` numbers among them), and ids that are
    removed, which are little more than their ids and have files of their own."""

    df: DataFrame
    finish: Callable[[DataFrame], DataFrame] | None = None
    dim: int = 0
    gone: tuple[DataFrame, ...] = ()


class IndexStore:
    """Reader and writer of one index. One writer at a time; readers need not wait for it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._columns = {"embeddings": schemas.EMBEDDINGS, "chunks": schemas.CHUNKS, "outline": schemas.OUTLINE}

    # the log

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise IndexNotFound(self.root) from error
            raise

    def _since_reset(self) -> DataFrame:
        log = self._log()
        reset = log.filter("action = 'reset'").agg(F.max("version").alias("v")).first()["v"]
        return log.filter(F.col("version") >= reset) if reset is not None else log

    def _version(self) -> int:
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] if self.exists() else 0

    def batches(self, table: str | None = None, collection: str | None = None) -> list[Batch]:
        """Live batches, which are as many as commits since the last compaction."""
        log = self._since_reset()
        gone = log.filter("action = 'remove'").select("table", "collection", "batch")
        live = log.filter("action = 'add'").join(gone, ["table", "collection", "batch"], "left_anti")
        for name, value in (("table", table), ("collection", collection)):
            live = live if value is None else live.filter(F.col(name) == value)
        names = list(Batch.__dataclass_fields__)
        return [Batch(**r.asDict()) for r in live.select(*names).orderBy("version", "table", "collection").collect()]

    def _commit(self, entries: list[dict]) -> None:
        """All entries become visible with one file, or none does."""
        version = self._version() + 1
        rows = [tuple({"version": version, **e}.get(f.name) for f in _LOG.fields) for e in entries]
        made = self.spark.createDataFrame(rows, _LOG).withColumn("updated", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    # catalog

    def exists(self) -> bool:
        try:
            self._log()
            return True
        except IndexNotFound:
            return False

    def collections(self) -> DataFrame:
        created = self._since_reset().filter("action = 'create'")
        return created.select(F.col("collection").alias("name"), "model", "dim", "updated")

    def collection_names(self) -> list[str]:
        return [r["name"] for r in self.collections().select("name").orderBy("name").collect()]

    def model_of(self, collection: str) -> str | None:
        row = self.collections().filter(F.col("name") == collection).head()
        return row["model"] if row else None

    def _entry(self, collection: str):
        row = self.collections().filter(F.col("name") == collection).head()
        if row is None:
            raise CollectionNotFound(collection, self.collection_names())
        return row

    def require_model(self, collection: str, model: str, dim: int) -> None:
        """A search only makes sense with vectors of the model the collection was built with."""
        row = self._entry(collection)
        if (row["model"], row["dim"]) != (model, dim):
            raise ModelMismatch(f"{collection!r} was built with {row['model']} ({row['dim']}), not {model} ({dim})")

    def require_free(self, collection: str, force: bool = False) -> None:
        """Refuse a name that is taken, unless `force` is about to empty the index."""
        if not force and self.exists() and collection in self.collection_names():
            raise CollectionExists(collection)

    def create(self, collection: str, model: str, dim: int, force: bool = False) -> None:
        """Register a collection. An existing one is refused; `force` empties the whole index, with every
        other collection in it."""
        self.require_free(collection, force)
        entry = {"action": "create", "collection": collection, "model": model, "dim": dim}
        self._commit(([{"action": "reset"}] if force else []) + [entry])

    # reading

    def _folder(self, table: str, batch: str) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _scan(self, table: str, batches: list[Batch], schema: T.StructType) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(table, b) for b in dict.fromkeys(x.batch for x in batches)])

    def _merged(self, table: str, batches: list[Batch], collection: str | None) -> DataFrame:
        """The base without the ids that deltas changed, and the last version of those."""
        schema = self._columns[table]

        def own(kind: str, fields: list[T.StructField]) -> DataFrame:
            found = self._scan(table, [b for b in batches if b.kind == kind], T.StructType([*schema.fields, *fields]))
            return found if collection is None else found.filter(F.col("collection") == collection)

        base, deltas = own("base", []), [b for b in batches if b.kind == "delta"]
        if not deltas:
            return base
        last = own("delta", [_VERSION, _GONE])
        if max(Counter(b.collection for b in deltas).values()) > 1:  # a delta has an id once
            rest = [F.col(c) for c in [*schema.names[2:], "gone"]]  # all but the keys
            last = last.groupBy("collection", "id").agg(F.max_by(F.struct(*rest), "version").alias("row"))
            last = last.select("collection", "id", "row.*")
        changed = last.select("collection", "id")
        if sum(b.id_bytes for b in deltas) <= BROADCAST_ID_BYTES:
            changed = F.broadcast(changed)
        kept = base.join(changed, ["collection", "id"], "left_anti")
        return kept.select(*schema.names).unionByName(last.filter(~F.col("gone")).select(*schema.names))

    def _table(self, table: str, collection: str | None) -> DataFrame:
        if collection is not None:
            self._entry(collection)
        return self._merged(table, self.batches(table, collection), collection)

    def embeddings(self, collection: str | None = None) -> DataFrame:
        return self._table("embeddings", collection)

    def chunks(self, collection: str | None = None) -> DataFrame:
        return self._table("chunks", collection)

    def lookup(self, table: str, collection: str, keys: DataFrame, column: str = "id") -> DataFrame:
        """Rows whose `column` is among that of `keys`. Few keys become literals, which the footers' ranges and Bloom
        filters answer for most files; many are joined."""
        rows = self._table(table, collection)
        wanted = keys.select(column).filter(F.col(column).isNotNull()).distinct()
        few = wanted.limit(MAX_LITERAL_KEYS + 1).collect()
        if len(few) > MAX_LITERAL_KEYS:
            return rows.join(wanted, column, "left_semi").select(*rows.columns)
        return rows.filter(F.col(column).isin([r[0] for r in few]))

    # writing

    def _write(self, new: DataFrame | _Rows, table: str, fields: list[T.StructField], like: list[Batch] | None = None) -> tuple[str, list[dict]]:
        """A batch in a folder of its own, and what the log is to say of it, for each of its collections."""
        new, batch = new if isinstance(new, _Rows) else _Rows(new), uuid.uuid4().hex
        made = self._write_part(new, table, fields, batch, like, 0)
        for ids in new.gone:
            made += self._write_part(_Rows(ids), table, fields, batch, None, sum(e["bytes"] for e in made))
        return batch, _by_collection(made)

    def _write_part(
        self, new: _Rows, table: str, fields: list[T.StructField], batch: str, like: list[Batch] | None, before: int
    ) -> list[dict]:
        """Rows in files of a batch that holds `before` bytes already.

        The rows are counted first, to cut them into files that a task can sort. Those that are dear to make are made once:
        they are cut like the batches `like`, which they come from, and counted when they are stored. Columns that the rows lack
        are added when they are cut and sorted, so that vectors are made once and go from there into the file.
        """
        df, finish = new.df, new.finish
        names = [*self._columns[table].names, *[f.name for f in fields]]
        counts = [F.count("*").alias("rows"), F.sum(F.octet_length("id")).alias("id_bytes")]
        keys = SORT_KEYS[table]
        if like is None:
            text = F.coalesce(F.octet_length("content"), F.lit(0)) if "content" in df.columns else F.lit(0)
            vector = 4 * F.coalesce(F.size("vector"), F.lit(0)) if "vector" in df.columns else F.lit(4 * new.dim)
            size = F.sum(F.octet_length("id") + text + vector + ROW_BYTES).alias("size")
            found = df.groupBy("collection").agg(*counts, size).collect()  # one row for each collection that the batch touches
            rows, held = sum(r["rows"] for r in found), sum(r["size"] for r in found)
        else:
            rows = sum(b.rows for b in like)
            held = max(2 * ROW_BYTES * rows, 3 * sum(b.bytes for b in like))
        if not rows:
            return []
        files = max(1, math.ceil(held / FILE_BYTES))
        if finish is not None:
            files = max(files, min(2 * self.spark.sparkContext.defaultParallelism, math.ceil(held / FINISH_BYTES)))
        # one file as well is sorted by a task of its own, so that what makes the rows keeps its many tasks
        if finish is None and files > 1 and "vector" not in names:
            dealt = in_ranges(df.select(*names), keys, files, rows)
        else:  # few rows, or vectors, which do not get smaller as packed columns
            dealt = (df if finish else df.select(*names)).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
            dealt = finish(dealt).select(*names) if finish else dealt
        writer = dealt.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd")
        for key in BLOOM_KEYS[table]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", math.ceil(rows / files))
        writer.parquet(self._folder(table, batch))
        if like is not None:
            found = self.spark.read.schema(self._columns[table]).parquet(self._folder(table, batch)).groupBy("collection").agg(*counts).collect()
            rows = sum(r["rows"] for r in found)
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self._folder(table, batch))
        written_bytes = listed.agg(F.sum("length")).first()[0] - before
        return [
            {"table": table, "collection": r["collection"], "batch": batch, "rows": r["rows"], "id_bytes": r["id_bytes"], "bytes": written_bytes * r["rows"] // rows}
            for r in found
        ]

    def _aligned(self, table: str, new: DataFrame, collection: str) -> DataFrame:
        """The columns of the table; those a caller need not give are null."""
        new = new.withColumn("collection", F.lit(collection)).withColumn("updated", F.current_timestamp())
        for field in self._columns[table].fields:
            if field.name not in new.columns and field.nullable:
                new = new.withColumn(field.name, F.lit(None).cast(field.dataType))
        return new

    def _tombstones(self, table: str, ids: DataFrame) -> DataFrame:
        """Rows `(collection, id)` as removals."""
        fields = [f for f in self._columns[table].fields if f.name not in ("collection", "id", "updated")]
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return ids.select("collection", "id", *nulls, F.current_timestamp().alias("updated"), F.lit(True).alias("gone"))

    def build(
        self,
        collection: str,
        model: str,
        dim: int,
        embeddings: DataFrame | None = None,
        chunks: DataFrame | None = None,
        force: bool = False,
        finish: Finish | None = None,
    ) -> None:
        """Register a collection together with the rows it begins with: readers see both or neither.

        `finish` has, for a table, what adds the columns that its rows still lack, as vectors. It takes the rows as they are
        cut into files and sorted, may read any of their columns, and adds and drops no row.
        """
        self.require_free(collection, force)
        entries = [{"action": "reset"}] if force else []
        entries.append({"action": "create", "collection": collection, "model": model, "dim": dim})
        for table, new in (("embeddings", embeddings), ("chunks", chunks)):
            if new is not None:
                made = self._write(_Rows(self._aligned(table, new, collection), (finish or {}).get(table), dim), table, [])[1]
                entries += [{"action": "add", "kind": "base", **e} for e in made]
        self._commit(entries)

    def upsert(
        self,
        collection: str,
        embeddings: DataFrame | None = None,
        chunks: DataFrame | None = None,
        order: list[str] | None = None,
        gone: DataFrame | None = None,
        global_ids: bool = False,
        finish: Finish | None = None,
    ) -> None:
        """Insert or replace by id, and remove the ids of `gone`, in one commit for both tables.

        `embeddings`: id, vector, content, metadata, and perhaps type, path and parent_id; `chunks`: the chunk columns
        without collection and updated. `order` names columns that tell which repetition of an id is last; without it
        ids are unique. An id in `gone` that comes again stays. With `global_ids` an id lives in one collection: storing
        it here removes it from all others. `finish` as in `build`. The tables are read more than once, so give tables rather
        than computations.
        """
        dim = self._entry(collection)["dim"]
        version, entries = self._version() + 1, []
        for table, new in (("embeddings", embeddings), ("chunks", chunks)):
            if new is None:
                continue
            rows = self._aligned(table, latest(new, ["id"], order) if order else new, collection)
            live = self.batches(table)
            first, removed = not any(b.collection == collection for b in live), []
            if first and not global_ids:
                kind, fields = "base", []
            else:
                kind, fields = "delta", [_VERSION, _GONE]
                rows = rows.withColumn("gone", F.lit(False)).withColumn("version", F.lit(version).cast("long"))
                if gone is not None:
                    removed.append(gone.select(F.lit(collection).alias("collection"), "id").join(new.select("id"), "id", "left_anti"))
                if global_ids:
                    known = self._merged(table, live, None).select("collection", "id").filter(F.col("collection") != collection)
                    removed.append(known.join(new.select("id"), "id", "left_semi"))
            ids = [written(df.select("collection", "id").distinct(), "ids-removed") for df in removed]
            dead = tuple(self._tombstones(table, df).withColumn("version", F.lit(version).cast("long")) for df in ids)
            made = self._write(_Rows(rows, (finish or {}).get(table), dim, dead), table, fields)[1]
            entries += [{"action": "add", "kind": kind, **e} for e in made]
        if entries:
            self._commit(entries)

    def upsert_embeddings(self, collection: str, new: DataFrame, order: list[str] | None = None, gone: DataFrame | None = None) -> None:
        self.upsert(collection, embeddings=new, order=order, gone=gone)

    def upsert_chunks(self, collection: str, new: DataFrame, order: list[str] | None = None, gone: DataFrame | None = None) -> None:
        self.upsert(collection, chunks=new, order=order, gone=gone)

    # upkeep

    def compact(self, collection: str, least_deltas: int = 1) -> bool:
        """Fold the deltas of a collection into a new base, sorted anew, if a table has `least_deltas` of them."""
        entries = []
        for table in ("embeddings", "chunks"):
            live = self.batches(table, collection)
            if sum(b.kind == "delta" for b in live) < least_deltas:
                continue
            entries += [{"action": "add", "kind": "base", **e} for e in self._write(self._merged(table, live, collection), table, [])[1]]
            entries += [{"action": "remove", "table": table, "collection": collection, "batch": b.batch} for b in live]
        if entries:
            self._commit(entries)
        return bool(entries)

    def vacuum(self) -> int:
        """Empty the folders of batches that are live in no collection; readers of earlier commits lose them.

        Spark can only overwrite, so an empty file stays in each folder.
        """
        named = self._log().filter("action = 'add'").select("table", "batch").distinct()
        live = {(b.table, b.batch) for b in self.batches()}
        dead = [r for r in named.collect() if (r["table"], r["batch"]) not in live]
        for row in dead:
            nothing = self.spark.createDataFrame([], self._columns[row["table"]])
            nothing.write.mode("overwrite").parquet(self._folder(row["table"], row["batch"]))
        return len(dead)

    # the outline: chunks with their place in the hierarchy

    def put_outline(self, collection: str, rows: DataFrame) -> None:
        """Replace the outline of a collection; it belongs to the chunks as they are now."""
        old = self.batches("outline", collection)
        made = self._write(self._aligned("outline", rows, collection), "outline", [], self.batches("chunks", collection))[1]
        entries = [{"action": "add", "kind": "outline", **e} for e in made]
        self._commit(entries + [{"action": "remove", "table": "outline", "collection": collection, "batch": b.batch} for b in old])

    def outline(self, collection: str) -> DataFrame | None:
        """The stored outline, or None if there is none or chunks were changed since."""
        self._entry(collection)
        found, chunks = self.batches("outline", collection), self.batches("chunks", collection)
        if not found or any(b.version > found[-1].version for b in chunks if b.kind == "delta"):
            return None
        return self._scan("outline", found[-1:], schemas.OUTLINE).filter(F.col("collection") == collection)

    # reports

    def info(self) -> DataFrame:
        """Entries and size on disk per collection, also of collections that are still empty.

        Sizes, and counts where nothing was changed since the base was written, come from the log. Where there are
        deltas the merged ids are counted; a collection whose count fails has none, but its `error`.
        """
        live = [b for b in self.batches() if b.table != "outline"]
        rows = []
        for entry in self.collections().orderBy("name").collect():
            name, error = entry["name"], None
            own = [b for b in live if b.collection == name]
            held = [b for b in own if b.table == "embeddings"]
            n_bytes = sum(b.bytes for b in own)
            if all(b.kind == "base" for b in held):
                entries = sum(b.rows for b in held)
            else:
                try:
                    entries = self._merged("embeddings", held, name).select("id").count()
                except (PySparkException, Py4JError) as failure:
                    entries, error = None, str(failure).split("\n")[0]
            rows.append((self.root, name, entry["model"], entries, n_bytes, error))
        made = self.spark.createDataFrame(rows, "root string, collection string, model string, entries long, bytes long, error string")
        return made.withColumn("size", human_size(F.col("bytes")))


def _by_collection(made: list[dict]) -> list[dict]:
    """What the log is to say of a batch that was written in several parts: one entry for each collection."""
    found: dict[str, dict] = {}
    for part in made:
        own = found.setdefault(part["collection"], {**part, "rows": 0, "id_bytes": 0, "bytes": 0})
        for number in ("rows", "id_bytes", "bytes"):
            own[number] += part[number]
    return list(found.values())


def write_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines; NULL fields are left out."""
    results.write.mode("errorifexists").json(path)

