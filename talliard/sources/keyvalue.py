"""Editor databases: tables of keys and JSON values in SQLite files, as a Python data source that reads ranges of keys.

Filters on the key reach the database, which walks its index; a file's range is cut into splits of about ROWS keys, so one large file is
many tasks. With paths, the database takes these fields out of each value and hands on one JSON list a row, so that large
values don't leave it; a value that is no valid JSON comes as it is. A file is opened read-only where it lies, or from a copy that the task
makes where only a store's address is known; copies end with the task.
"""

import contextlib
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from talliard.operators.merge import MEASURES
from talliard.sources.logs import get, number
from talliard.sources.tail import opened

ROWS = 50_000
#: Values that are fetched at once.
FETCH = 256
#: Milliseconds to wait for a writer.
BUSY = 5000
SCHEMA = "file string, key string, value string"
ARROW = pa.schema([("file", pa.string()), ("key", pa.string()), ("value", pa.string())])
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
# Tables, key prefixes and kinds of entries.
ENTRIES, ITEMS = "cursorDiskKV", "ItemTable"
COMPOSER, BUBBLE = "composerData:", "bubbleId:"
USER, ASSISTANT = 1, 2


@contextlib.contextmanager
def database(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection; where the file can't be locked and nobody writes, to the file as it is."""
    system, inner = opened(path)
    copied = None
    if system.type_name != "local":
        with tempfile.NamedTemporaryFile(delete=False) as copy, system.open_input_stream(inner) as source:
            while block := source.read(1 << 20):
                copy.write(block)
        copied = inner = copy.name
    try:
        uri = f"file:{inner.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro"
        db = sqlite3.connect(uri, uri=True, timeout=BUSY / 1000)
        try:
            db.execute("select name from sqlite_master limit 1").fetchall()
        except sqlite3.OperationalError:
            db.close()
            if os.path.exists(inner + "-wal"):
                raise
            db = sqlite3.connect(uri + "&immutable=1", uri=True)
        try:
            yield db
        finally:
            db.close()
    finally:
        if copied:
            os.remove(copied)


class Keys(InputPartition):
    def __init__(self, file: str, where: str, values: tuple, first: str | None, end: str | None):
        super().__init__((file, first))
        self.file, self.where, self.values, self.first, self.end = file, where, values, first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.table = options["path"], options.get("glob", "*"), options["table"]
        self.rows, self.paths = int(options.get("rows", ROWS)), [p for p in options.get("paths", "").split("|") if p]
        self.tests: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(getattr(f, "value", None), str) and type(f) in _SIGNS:
                self.tests.append((f"key {_SIGNS[type(f)]} ?", f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and f.value:
                self.tests.append(("key >= ?", f.value))
                yield f
            else:
                yield f

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, path = opened(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) or [system.get_file_info(path)]
        return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, self.glob))

    def partitions(self) -> list[Keys]:
        """Ranges between keys that are so many apart; only the index is read, on the driver."""
        where, values = " and ".join(["value is not null", *(t for t, _ in self.tests)]), tuple(v for _, v in self.tests)
        found = []
        for file in self._files():
            cuts: list[str | None] = [None]
            with contextlib.suppress(sqlite3.DatabaseError), database(file) as db:
                held = where.replace("value is not null and ", "").replace("value is not null", "1")
                while row := db.execute(f'select key from "{self.table}" where {held}{" and key > ?" if cuts[-1] else ""} order by key limit 1 offset ?', (*values, *([cuts[-1]] if cuts[-1] else []), self.rows)).fetchone():
                    cuts.append(row[0])
            found += [Keys(file, where, values, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return found or [Keys("", where, values, None, None)]

    def read(self, part: Keys) -> Iterator[pa.RecordBatch]:
        """A file that is no database, or lacks the table, has no rows."""
        if not part.file:
            return
        where, values = part.where, list(part.values)
        for sign, bound in ((">=", part.first), ("<", part.end)):
            if bound is not None:
                where, values = f"{where} and key {sign} ?", [*values, bound]
        value = "value"
        if self.paths:
            each = ", ".join(f"'{p}'" for p in self.paths)
            value = f"case when json_valid(value) then {'json_extract' if len(self.paths) > 1 else 'json_array(json_extract'}(value, {each}){'' if len(self.paths) > 1 else ')'} else value end"
        text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        try:
            with database(part.file) as db:
                db.text_factory = lambda b: b.decode("utf-8", "replace")
                rows = db.execute(f'select key, {value} from "{self.table}" where {where} order by key', values)
                while some := rows.fetchmany(FETCH):
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(some)), pa.array([text(r[0]) for r in some]), pa.array([text(r[1]) for r in some])], schema=ARROW)
        except sqlite3.DatabaseError as e:
            if not ("no such table" in str(e) or "not a database" in str(e)):
                raise


class KeyValues(DataSource):
    """Options: path, table, glob, rows (of a split), paths (of JSON fields, with | between)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_key_values"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def key_values(spark: SparkSession, path: str, name: str, glob: str = "*", paths: list[str] | None = None, **options) -> DataFrame:
    """(file, key, value) of a table in all databases below path. Turns on Spark's handing of filters to Python sources."""
    spark.dataSource.register(KeyValues)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_key_values").option("path", path).option("table", name).option("glob", glob).option("paths", "|".join(paths or []))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key begins with prefix, as a range that an index can walk."""
    return rows.where((F.col("key") >= prefix) & (F.col("key") < prefix[:-1] + chr(ord(prefix[-1]) + 1)))


def _moment(v: Column) -> Column:
    """A number of milliseconds, or of seconds where it is small, or a time as text."""
    n, kind = F.try_variant_get(v, "$", "double"), F.schema_of_variant(v)
    ms = F.when((n > 0) & (n < float("inf")), F.when(n < 1e11, n * 1000).otherwise(n))
    return F.when(kind == "STRING", F.try_to_timestamp(F.try_variant_get(v, "$", "string"))).otherwise(F.timestamp_millis(ms.cast("long")))


def folders(spark: SparkSession, path: str, glob: str = "state.vscdb", **options) -> DataFrame:
    """(composer, folder): which project each chat belongs to, from the databases and the workspace.json of the folders below path."""
    about = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "workspace.json").option("wholetext", True).text(path)
    at = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]*$", 1)
    about = about.select(at(F.col("_metadata.file_path")).alias("dir"), F.try_parse_json("value").alias("v"))
    uri = F.coalesce(F.nullif(get("$.folder"), F.lit("")), F.nullif(get("$.workspace"), F.lit("")))
    local = F.regexp_replace(F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file://[^/]*", ""), r"\+", "%2B")), r"^/([A-Za-z]:)", "$1")
    about = about.select("dir", F.when(uri.startswith("file:"), local).otherwise(uri).alias("folder")).where("folder <> ''")
    items = key_values(spark, path, ITEMS, glob, **options).where("key = 'composer.composerData'").select(at(F.col("file")).alias("dir"), F.try_parse_json("value").alias("v"))
    ids = items.select("dir", F.explode(get("$.allComposers", "array<struct<composerId:string>>")["composerId"]).alias("composer")).where("composer <> ''")
    return ids.join(about, "dir").groupBy("composer").agg(F.max_by("folder", "dir").alias("folder"))


def editor(spark: SparkSession, path: str, glob: str = "state.vscdb", places: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(usage, prompts) of the chats in databases below path; places: (composer, folder).

    An answer counts where it has tokens; its time and model are its own, else its chat's. A prompt's model is that of the next answer's entry in the
    chat's order, and if that one entry names none, the chat's.
    """
    field = lambda k, kind="string": F.try_variant_get("v", f"$[{k}]", kind)
    entries = lambda prefix, paths: prefixed(key_values(spark, path, ENTRIES, glob, paths, **options), prefix).withColumn("v", F.try_parse_json("value"))
    one = lambda json, listed: F.when(F.schema_of_variant("v").startswith("ARRAY"), listed).otherwise(json)  # noqa: E731  values that aren't valid for the database are read whole
    c = entries(COMPOSER, ["$.createdAt", "$.modelConfig.modelName", "$.fullConversationHeadersOnly"]).where("v is not null")
    heads = "array<struct<bubbleId:string,type:bigint>>"
    chats = c.select("file", F.substring("key", len(COMPOSER) + 1, 1 << 30).alias("composer"), _moment(one(get("$.createdAt", "variant"), field(0, "variant"))).alias("begun"), F.coalesce(one(get("$.modelConfig.modelName"), field(1)), F.lit("")).alias("own"), one(get("$.fullConversationHeadersOnly", heads), field(2, heads)).alias("heads"))
    b = entries(BUBBLE, ["$.type", "$.createdAt", "$.tokenCount.inputTokens", "$.tokenCount.outputTokens", "$.usageUuid", "$.modelInfo.modelName", "$.workspaceProjectDir", "$.text", "$.images[0]"]).where("v is not null")
    parts = F.regexp_extract("key", "^" + BUBBLE + "([^:]+):(.+)$", 1), F.regexp_extract("key", "(?s)^" + BUBBLE + "([^:]+):(.+)$", 2)
    text = lambda json, k: F.coalesce(one(get(json), field(k)), F.lit(""))
    image = one(get("$.images[0]", "variant"), field(8, "variant"))
    said = b.select(
        "file", parts[0].alias("composer"), parts[1].alias("bubble"), one(get("$.type", "double"), field(0, "double")).cast("int").alias("kind"), _moment(one(get("$.createdAt", "variant"), field(1, "variant"))).alias("ts"),
        F.coalesce(one(number("$.tokenCount.inputTokens"), field(2, "bigint")), F.lit(0)).alias("n_in"), F.coalesce(one(number("$.tokenCount.outputTokens"), field(3, "bigint")), F.lit(0)).alias("n_out"),
        text("$.usageUuid", 4).alias("uuid"), text("$.modelInfo.modelName", 5).alias("named"), text("$.workspaceProjectDir", 6).alias("dir"), text("$.text", 7).alias("text"), (image.isNotNull() & ~F.is_variant_null(image)).alias("image"),
    ).where("composer <> '' and bubble <> ''")
    places = places if places is not None else spark.createDataFrame([], "composer string, folder string")
    said = said.join(chats.drop("heads"), ["file", "composer"], "left").join(places, "composer", "left")
    said = said.withColumns({"at": F.coalesce("ts", "begun"), "cwd": F.coalesce(F.nullif("dir", F.lit("")), "folder", F.lit("")), "id": F.concat("composer", F.lit(":"), "bubble")})
    counted = (F.col("kind") == ASSISTANT) & ((F.col("n_in") > 0) | (F.col("n_out") > 0))
    zero = F.lit(0).cast("long")
    measures = {m: zero for m in MEASURES} | {"tok_in": F.col("n_in"), "tok_out": F.col("n_out"), "calls": F.lit(1).cast("long")}
    usage = said.where(counted & F.col("at").isNotNull()).withColumns(measures)
    usage = usage.select(
        "file", F.coalesce(F.nullif("uuid", F.lit("")), "id").alias("native_key"), F.col("at").alias("ts"), F.when(F.col("ts").isNull(), "session-start").otherwise("event").alias("ts_q"), F.col("composer").alias("session"),
        F.coalesce(F.nullif("named", F.lit("")), "own", F.lit("")).alias("model"), "cwd", F.lit(None).cast("string").alias("hint"), *MEASURES,
    )
    order = chats.select("file", "composer", F.posexplode("heads").alias("place", "h")).select("file", "composer", "place", F.col("h.bubbleId").alias("bubble"), F.col("h.type").alias("kind"))
    back = Window.partitionBy("file", "composer").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    follows = order.withColumn("next", F.last(F.when(F.col("kind") == ASSISTANT, F.col("bubble")), True).over(back))
    follows = follows.groupBy("file", "composer", "bubble").agg(F.min_by("next", "place").alias("next"))
    models = said.where(F.col("kind") == ASSISTANT).select("file", "composer", F.col("bubble").alias("next"), F.col("named").alias("answer"))
    told = said.where(counted).select("file", "composer").distinct().withColumn("has_usage", F.lit(True))
    blank = ~F.col("text").rlike(r"\S")
    prompts = said.where((F.col("kind") == USER) & F.col("at").isNotNull() & (~blank | F.col("image")))
    prompts = prompts.join(follows, ["file", "composer", "bubble"], "left").join(models, ["file", "composer", "next"], "left").join(told, ["file", "composer"], "left")
    prompts = prompts.select(
        "file", F.col("id").alias("native_key"), F.col("at").alias("ts"), F.col("composer").alias("session"), F.coalesce(F.nullif("answer", F.lit("")), "own", F.lit("")).alias("model"), "cwd",
        F.when(blank, "[image]").otherwise(F.col("text")).alias("text"), F.coalesce("has_usage", F.lit(False)).alias("has_usage"),
    )
    both = {"provider": F.lit("cursor"), "source": F.lit("cursor")}
    return usage.withColumns(both), prompts.withColumns(both)
