"""What tools keep beside their logs: prompt histories and turn summaries, used only for sessions without a log of their own.

Precedence is an anti-join by session. A young entry waits, as its session's log may not be written yet: a history file is read up to
its first young entry that no log explains, and a later run decides on the rest. Paths go to Spark's readers.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.operators.merge import MEASURES
from talliard.sources import logs
from talliard.sources.logs import get, number, present, text

#: An entry is young for so many minutes.
YOUNG = 10
# The mark of a pasted text, a command, and names of hashes that would leave their folder.
PASTE = r"\[Pasted text #(\d+)(?: \+\d+ lines)?\]"
COMMAND = r"^/[A-Za-z0-9:_-]+(\s|$)"
OUTSIDE = r"[/\\.]"
_PASTED = "map<string,struct<type:string,content:string,contentHash:string>>"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, changed) of files, whose content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))


def named_sessions(spark: SparkSession, path: str, glob: str = "*.jsonl", name: str = r"([^/]*)\.jsonl$") -> DataFrame:
    """(session) of the log files below path, by their names; Spark doesn't list empty files."""
    return _files(spark, path, glob).select(F.regexp_extract("file", name, 1).alias("session")).where("session <> ''").distinct()


def _old_enough(entries: DataFrame, now: str) -> DataFrame:
    """entries (file, at, ts) up to each file's first young one."""
    young = F.col("ts") > F.expr(f"timestamp'{now}' - interval {YOUNG} minutes")
    first = entries.where(young).groupBy("file").agg(F.min("at").alias("_first"))
    return entries.join(first, "file", "left").where(F.col("_first").isNull() | (F.col("at") < F.col("_first"))).drop("_first")


def _prompts(entries: DataFrame, provider: str, source: str) -> DataFrame:
    """Prompts as logs' readers give them; no answer is known, so no usage and no model."""
    key = F.concat(F.lit("hist:"), "session", F.lit(":"), F.col("stamp").cast("string"))
    rows = entries.select("file", key.alias("native_key"), "ts", "session", F.lit("").alias("model"), "cwd", "text", F.lit(False).alias("has_usage"))
    return rows.withColumns({"provider": F.lit(provider), "source": F.lit(source)})


def expanded(entries: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """entries (key, shown, pasted) with text: shown with its paste marks replaced by the pasted texts.

    pasted: id to (type, content, contentHash); cache: (hash, content) of pastes that are kept elsewhere. A mark whose text isn't known, or is
    no text, stays. Texts are cut at their marks, pieces are looked up by a join and put together in order; entries without
    marks or pastes pass by. Pasted texts that hold marks themselves are not cut again.
    """
    marked = F.col("shown").rlike(PASTE) & (F.coalesce(F.size("pasted"), F.lit(0)) > 0)
    between, marks = F.split("shown", PASTE, -1), F.regexp_extract_all("shown", F.lit(PASTE), F.lit(0))
    pieces = entries.where(marked).select("key", "pasted", F.posexplode(F.arrays_zip(between.alias("t"), marks.alias("m"), F.regexp_extract_all("shown", F.lit(PASTE), F.lit(1)).alias("n"))).alias("at", "p"))
    p = F.when(F.try_element_at("pasted", F.col("p.n"))["type"] == "text", F.try_element_at("pasted", F.col("p.n")))
    pieces = pieces.select("key", "at", F.col("p.t").alias("t"), F.col("p.m").alias("m"), F.nullif(p["content"], F.lit("")).alias("inline"), F.when(~p["contentHash"].rlike(OUTSIDE), F.nullif(p["contentHash"], F.lit(""))).alias("hash"))
    if cache is not None:
        asked = F.when(F.col("inline").isNull(), F.col("hash"))
        pieces = pieces.withColumn("hash", asked).join(cache.select("hash", F.col("content").alias("kept")), "hash", "left")
    else:
        pieces = pieces.withColumn("kept", F.lit(None).cast("string"))
    piece = F.concat("t", F.coalesce("inline", "kept", "m", F.lit("")))
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", piece.alias("t")))).alias("ps")).select("key", F.array_join("ps.t", "").alias("_whole"))
    return entries.join(whole, "key", "left").withColumn("text", F.coalesce("_whole", "shown")).drop("_whole")


def claude_history(spark: SparkSession, path: str, sessions: DataFrame, now: str, glob: str = "history.jsonl", cache: DataFrame | None = None) -> DataFrame:
    """Prompts of history entries whose session is none of sessions; commands and what tools wrote are left out.

    The cache of pastes is read from paste-cache/*.txt below path unless it is given.
    """
    rows = logs.lines(spark, path, glob).select(
        "file", "at", text("$.display").alias("shown"), number("$.timestamp").alias("stamp"), text("$.project").alias("cwd"), text("$.sessionId").alias("session"), get("$.pastedContents", _PASTED).alias("pasted"),
    ).where("stamp <> 0").withColumn("ts", F.timestamp_millis("stamp"))
    rows = _old_enough(rows.join(sessions.where("session <> ''"), "session", "left_anti"), now).withColumn("key", F.struct("file", "at"))
    if cache is None:
        kept = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("wholetext", True).text(path)
        cache = kept.select(F.regexp_extract(F.col("_metadata.file_path"), r"/paste-cache/([^/]*)\.txt$", 1).alias("hash"), F.col("value").alias("content")).where("hash <> ''").dropDuplicates(["hash"])
    found = expanded(rows, cache)
    start = F.regexp_replace("text", r"^\s+", "")
    return _prompts(found.where((start != "") & ~start.startswith("<") & ~start.rlike(COMMAND)), "anthropic", "claude-code")


def _typed(c: str) -> Column:
    start = F.regexp_replace(c, r"^\s+", "")
    return (start != "") & ~start.startswith("<") & ~start.startswith("# AGENTS")


def _codex_entries(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = logs.lines(spark, path, glob).select("file", "at", text("$.session_id").alias("session"), number("$.ts").alias("stamp"), text("$.text").alias("text"), F.lit("").alias("cwd"))
    return rows.where("stamp <> 0").withColumn("ts", F.timestamp_seconds("stamp"))


def codex_history(spark: SparkSession, path: str, sessions: DataFrame, now: str, glob: str = "history.jsonl") -> DataFrame:
    """Prompts of history entries whose session is none of sessions."""
    rows = _codex_entries(spark, path, glob).join(sessions.where("session <> ''"), "session", "left_anti")
    return _prompts(_old_enough(rows, now).where(_typed("text")), "openai", "codex")


def missing_logs(spark: SparkSession, path: str, sessions: DataFrame, now: str, glob: str = "history.jsonl") -> DataFrame:
    """One row: sessions and prompts of all histories below path that no log explains, and history, the prompts checked; a prompt in two histories counts once."""
    rows = _codex_entries(spark, path, glob).where(F.col("ts") <= F.expr(f"timestamp'{now}' - interval {YOUNG} minutes")).where("session <> ''").where(_typed("text"))
    once = rows.select("session", "stamp").distinct().join(sessions.distinct().withColumn("_has", F.lit(True)), "session", "left")
    gone = F.col("_has").isNull()
    return once.agg(F.count_distinct(F.when(gone, F.col("session"))).alias("sessions"), F.count_if(gone).alias("prompts"), F.count("*").alias("history"))


def grok_turns(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Usage by the turns of usage.json, of sessions (folders) whose updates have no finished turn and which have been quiet for a while."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    update = logs.lines(spark, path, "updates.jsonl").select(folder(F.col("file")).alias("dir"), get("$.params.update", "variant").alias("u"))
    told = update.where((text("$.sessionUpdate", "u") == "turn_completed") & present("$.usage", "u")).select("dir").distinct()
    since = F.expr(f"timestamp'{now}' - interval {YOUNG} minutes")
    busy = _files(spark, path, "{updates.jsonl,usage.json}").where(F.col("changed") > since).select(folder(F.col("file")).alias("dir")).distinct()
    whole = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), folder(F.col("_metadata.file_path")).alias("dir"), F.try_parse_json("value").alias("s")).where("s is not null")
    about = whole("summary.json").select("dir", text("$.info.id", "s").alias("id"), text("$.info.cwd", "s").alias("cwd"), text("$.current_model_id", "s").alias("own"))
    files = whole("usage.json").join(told, "dir", "left_anti").join(busy, "dir", "left_anti").join(about, "dir", "left")
    session = F.coalesce(F.nullif(text("$.sessionId", "s"), F.lit("")), "id", F.lit(""))
    turns = files.select("file", session.alias("session"), F.coalesce("cwd", F.lit("")).alias("cwd"), "own", F.explode(get("$.turns", "array<variant>", "s")).alias("v"))
    turns = turns.withColumns({"ended": text("$.endedAt"), "ts": F.try_to_timestamp(get("$.endedAt"))}).where("ts is not null")
    measures = {
        "tok_in": F.greatest(F.lit(0), number("$.inputTokens") - number("$.cachedReadTokens") - number("$.cacheCreationTokens")), "cache_w": number("$.cacheCreationTokens"), "cache_w1h": F.lit(0).cast("long"),
        "cache_r": number("$.cachedReadTokens"), "tok_out": number("$.outputTokens"), "reasoning": number("$.reasoningTokens"), "calls": number("$.modelCalls"),
    }
    key = F.concat_ws(":", "session", number("$.turnNumber").cast("string"), "ended")
    rows = turns.withColumns(measures).withColumns({"native_key": key, "model": F.coalesce(F.nullif(text("$.primaryModelId"), F.lit("")), "own", F.lit("")), "hint": F.lit(None).cast("string")})
    return rows.select("file", "native_key", "ts", "session", "model", "cwd", "hint", *MEASURES).withColumns({"provider": F.lit("xai"), "source": F.lit("grok-cli")})
