"""Tool logs as typed rows: JSON lines read as text with their place in the file, then windows over each file.

Readers take a folder by any path Spark reads and return usage (native_key, ts, session, model, cwd, hint, measures)
and prompts (native_key, ts, session, model, cwd, text, has_usage), with provider and source; events() turns usage into
rows for merging. A line that is no JSON is skipped, a bad field is null. Reading a file again is harmless, as ids depend
on content only. Files may be split among tasks: a line's place is its block's start and its number in the task.

Very many small files may come packed: in few large ones, where each line has its file's name and a tab in front, as pack()
writes them. A file then lies whole and in order in one pack.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.operators.merge import MEASURES

#: Longer lines are skipped.
MOST_BYTES = 256 * 1024 * 1024
IMAGE_TAG = r"^</?image\b[^>]*>$"


def pack(rows: DataFrame, path: str) -> None:
    """rows (name, order, value) as packed files below path: lines of a name together, by their order."""
    rows.repartition("name").sortWithinPartitions("name", "order").select(F.concat("name", F.lit("\t"), "value").alias("value")).write.text(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """rows (file, value) of packed files with each line's own file and value."""
    tab = F.instr("value", "\t")
    return rows.where(tab > 0).withColumns({"file": F.concat("file", F.lit("/"), F.substring_index("value", "\t", 1)), "value": F.expr("substring(value, instr(value, '\t') + 1)")})


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", packed: bool = False) -> DataFrame:
    """(file, at, v) of all JSON lines below path; at sorts a file's lines."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    found = rows.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    found = (unpacked(found) if packed else found).where(F.octet_length("value") <= MOST_BYTES)
    return found.select("file", "at", F.try_parse_json("value").alias("v")).where("v is not null")


def get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def text(path: str, v: str = "v") -> Column:
    return F.coalesce(get(path, v=v), F.lit(""))


def number(path: str, v: str = "v") -> Column:
    return F.coalesce(get(path, "bigint", v), F.lit(0))


def present(path: str, v: str = "v") -> Column:
    """Neither absent nor a JSON null."""
    found = get(path, "variant", v)
    return found.isNotNull() & ~F.is_variant_null(found)  # which is false for null


def _so_far(value: Column) -> Column:
    """The last value up to this line."""
    return F.last(value, True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))


def _ahead(value: Column) -> Column:
    """The first value behind this line; over the reversed order, as frames that shrink cost the square of the lines."""
    return F.last(value, True).over(Window.partitionBy("file").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))


def _named(rows: DataFrame, provider: str, source: str) -> DataFrame:
    return rows.withColumns({"provider": F.lit(provider), "source": F.lit(source)})


def _content(path: str, texts: list[str]) -> Column:
    """(text, image, tool) of a content that is a string or a list of blocks; null for other shapes."""
    blocks = get(path, "array<struct<type:string,text:string>>")
    whole = F.when(F.schema_of_variant(F.coalesce(get(path, "variant"), F.parse_json(F.lit("null")))) == "STRING", get(path))
    has = lambda kind: F.exists(blocks, lambda b: b["type"] == kind)
    parts = F.transform(F.filter(blocks, lambda b: b["type"].isin(texts)), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(whole.isNotNull(), F.struct(whole.alias("text"), F.lit(False).alias("image"), F.lit(False).alias("tool"))).when(
        blocks.isNotNull(), F.struct(F.array_join(parts, "\n").alias("text"), F.coalesce(has("image"), F.lit(False)).alias("image"), F.coalesce(has("tool_result"), F.lit(False)).alias("tool"))
    )


def _typed(content: str) -> Column:
    """What a person wrote: the text, or a mark for an image alone; null for neither."""
    blank = F.trim(F.regexp_replace(f"{content}.text", r"^\s+|\s+$", "")) == ""
    return F.when(F.col(content).isNull() | F.col(f"{content}.tool"), None).when(~blank, F.col(f"{content}.text")).when(F.col(f"{content}.image"), "[image]")


def transcript(rows: DataFrame) -> DataFrame:
    """The fields of transcript lines (file, at, v), and whether a line's usage counts."""
    rows = rows.select(
        "file", "at", "v", text("$.type").alias("type"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), text("$.sessionId").alias("session"), text("$.uuid").alias("uuid"),
        text("$.cwd").alias("cwd"), text("$.message.model").alias("model"), F.when(present("$.message.usage"), get("$.message.usage", "variant")).alias("u"),
    )
    counted = (F.col("type") == "assistant") & F.col("u").isNotNull() & (F.col("model") != "<synthetic>") & F.col("ts").isNotNull()
    return rows.withColumn("counted", F.coalesce(counted, F.lit(False)))


def transcript_prompt(rows: DataFrame) -> DataFrame:
    """rows of transcript() with text: what a person wrote in the line, else null."""
    flag = lambda path: F.coalesce(get(path, "boolean"), F.lit(False))
    rows = rows.withColumns({"said": _content("$.message.content", ["text"]), "queued": _content("$.attachment.prompt", ["text"])}).withColumns({"said": _typed("said"), "queued": _typed("queued")})
    start = F.regexp_replace("said", r"^\s+", "")
    human = ~flag("$.isMeta") & ~flag("$.isCompactSummary") & text("$.origin.kind").isin("", "human") & ~start.startswith("[Request interrupted by user") & (~start.startswith("<") | (text("$.promptSource") == "typed"))
    later = (text("$.attachment.type") == "queued_command") & ~flag("$.attachment.isMeta") & (text("$.attachment.commandMode") == "prompt") & (text("$.attachment.origin.kind") == "human") & (F.col("uuid") != "")
    said = F.when((F.col("type") == "user") & human, F.col("said")).when((F.col("type") == "attachment") & later, F.col("queued"))
    return rows.withColumn("text", F.when(F.col("ts").isNotNull() & ~flag("$.isSidechain"), said))


def claude(spark: SparkSession, path: str, glob: str = "*.jsonl", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usage, prompts) of transcripts: streamed lines of a message count once, with the largest measures."""
    rows = transcript(lines(spark, path, glob, packed))
    org = F.when((F.col("type") == "attachment") & (text("$.attachment.type") == "credential_org") & F.col("ts").isNotNull(), F.nullif(get("$.attachment.organizationUuid"), F.lit("")))
    rows = rows.withColumn("hint", _so_far(org))
    key = F.coalesce(F.nullif(text("$.message.id"), F.lit("")), F.nullif(text("$.requestId"), F.lit("")), F.concat("session", F.lit(":"), "uuid"))
    fields = {"tok_in": "input_tokens", "cache_w": "cache_creation_input_tokens", "cache_w1h": "cache_creation.ephemeral_1h_input_tokens", "cache_r": "cache_read_input_tokens", "tok_out": "output_tokens", "reasoning": "output_tokens_details.thinking_tokens"}
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("at"))), F.lit(""))
    usage = (
        rows.where("counted").withColumn("native_key", key).withColumns({m: number(f"$.{f}", "u") for m, f in fields.items()})
        .groupBy("file", "native_key").agg(
            F.min("ts").alias("ts"), F.min_by("session", "at").alias("session"), first("model").alias("model"), first("cwd").alias("cwd"),
            F.min_by("hint", "at").alias("hint"), *(F.max(m).alias(m) for m in fields), F.lit(1).cast("long").alias("calls"),
        )
    )
    rows = rows.withColumn("model", F.coalesce(_ahead(F.when(F.col("counted"), F.nullif("model", F.lit("")))), F.lit("")))
    prompts = transcript_prompt(rows).where("text is not null")
    prompts = prompts.select("file", F.col("uuid").alias("native_key"), "ts", "session", "model", "cwd", "text", F.lit(True).alias("has_usage"))
    return _named(usage, "anthropic", "claude-code"), _named(prompts, "anthropic", "claude-code")


def _codex_measures(path: str) -> dict[str, Column]:
    n = lambda f: number(f"{path}.{f}")
    return {
        "tok_in": F.greatest(F.lit(0), n("input_tokens") - n("cached_input_tokens") - n("cache_write_input_tokens")), "cache_w": n("cache_write_input_tokens"), "cache_w1h": F.lit(0).cast("long"),
        "cache_r": n("cached_input_tokens"), "tok_out": n("output_tokens"), "reasoning": n("reasoning_output_tokens"), "calls": F.lit(1).cast("long"),
    }


def codex(spark: SparkSession, path: str, glob: str = "rollout-*.jsonl", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usage, prompts) of rollouts: records of usage, or in files without any before, rises of a cumulative counter."""
    rows = lines(spark, path, glob, packed).select("file", "at", "v", text("$.type").alias("type"), text("$.payload.type").alias("part"), F.try_to_timestamp(get("$.timestamp")).alias("ts"))
    is_meta, is_turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    in_file = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1)
    rows = rows.withColumn("metas", F.count_if(is_meta).over(in_file)).withColumn("first_meta", is_meta & (F.col("metas") == 1))
    sub = (get("$.payload.thread_source") == "subagent") | present("$.payload.source.subagent")
    name = F.regexp_extract("file", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    rows = rows.withColumns({
        "session": F.coalesce(_so_far(F.when(F.col("first_meta"), F.nullif(get("$.payload.id"), F.lit("")))), name),
        "subagent": F.coalesce(_so_far(F.when(F.col("first_meta"), F.coalesce(sub, F.lit(False)))), F.lit(False)),
        "cwd": F.coalesce(_so_far(F.when(F.col("first_meta"), text("$.payload.cwd")).when(is_turn, F.nullif(get("$.payload.cwd"), F.lit("")))), F.lit("")),
        "hint": _so_far(F.when(F.col("first_meta") & F.col("ts").isNotNull(), F.nullif(get("$.payload.creator_account_id"), F.lit("")))),
        "model": F.coalesce(_so_far(F.when(is_turn, F.nullif(get("$.payload.model"), F.lit("")))), F.lit("")),
        "model_turn": _so_far(F.when(is_turn, text("$.payload.turn_id"))), "recorded": F.max(F.col("type") == "token_usage_record").over(in_file),
    })
    kept = ["file", "native_key", "ts", "session", "model", "cwd", "hint", *MEASURES]
    records = rows.where("type = 'token_usage_record' and ts is not null").withColumn("native_key", text("$.payload.response_id")).withColumns(_codex_measures("$.payload.usage"))
    records = records.where((F.col("native_key") != "") & present("$.payload.usage"))
    total, w = "$.payload.info.total_token_usage.total_tokens", Window.partitionBy("file").orderBy("at")
    counts = rows.where("type = 'event_msg' and part = 'token_count' and not recorded and ts is not null").where(present("$.payload.info.total_token_usage"))
    counts = counts.withColumn("total", number(total)).withColumn("before", F.lag("total").over(w)).withColumn("epoch", F.coalesce(F.count_if(F.col("total") < F.col("before")).over(in_file), F.lit(0)))
    counts = counts.where("not (total <=> before)").where(present("$.payload.info.last_token_usage"))
    counts = counts.withColumn("native_key", F.concat_ws(":", "session", "epoch", "total")).withColumns(_codex_measures("$.payload.info.last_token_usage"))
    usage = records.select(*kept).unionByName(counts.select(*kept))

    # A prompt takes the model of its own turn, whose context may stand before or behind it.
    started = (F.col("type") == "event_msg") & (F.col("part") == "task_started")
    event = F.when(started | is_turn, F.struct(started.alias("started"), text("$.payload.turn_id").alias("turn"), F.nullif(F.when(is_turn, text("$.payload.model")), F.lit("")).alias("named")))
    rows = rows.withColumn("turn", F.coalesce(_so_far(F.when(started, text("$.payload.turn_id"))), F.lit(""))).withColumn("event", event).withColumn("next", _ahead(F.col("event")))
    rows = rows.withColumn("then", _ahead(F.when(F.col("event").isNotNull(), F.struct("next")))["next"])
    known = ((F.col("turn") == "") & (F.col("model") != "")) | ((F.col("turn") != "") & F.col("turn").eqNullSafe(F.col("model_turn")))
    own = F.coalesce("next.named", "model")
    model = (
        F.when(known | F.col("next").isNull(), F.col("model"))
        .when(F.col("next.started") & (F.col("turn") == "") & (F.col("model") == ""), F.when(~F.col("then.started"), F.coalesce("then.named", F.lit(""))).otherwise(""))
        .when(F.col("next.started"), F.col("model"))
        .when((F.col("turn") == "") | (F.col("turn") == F.col("next.turn")) | (F.col("model") == ""), own)
        .otherwise(F.col("model"))
    )
    blocks = get("$.payload.content", "array<struct<type:string,text:string>>")
    plain = F.filter(blocks, lambda b: b["type"].isin("input_text", "text"))
    frames = F.filter(plain, lambda b: ~F.trim(b["text"]).rlike(IMAGE_TAG))
    said = F.array_join(F.transform(frames, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    start = F.regexp_replace(said, r"^\s+", "")
    alone = F.when((F.size(plain) > 0) & F.exists(blocks, lambda b: b["type"] == "input_image"), "[image]")
    shown = F.when(F.trim(start) == "", alone).when(~start.startswith("<") & ~start.startswith("# AGENTS"), said)
    prompts = rows.where("type = 'response_item' and part = 'message' and ts is not null and not subagent").where((get("$.payload.role") == "user") & ~F.coalesce(get("$.metadata.inherited_user_message", "boolean"), F.lit(False)))
    prompts = prompts.withColumn("text", shown).where("text is not null").withColumn("model", model)
    key = F.concat_ws(":", "session", F.coalesce(get("$.ordinal", "bigint"), F.col("line")))
    prompts = prompts.select("file", key.alias("native_key"), "ts", "session", "model", "cwd", "text", F.lit(True).alias("has_usage"))
    return _named(usage, "openai", "codex"), _named(prompts, "openai", "codex")


def gemini(spark: SparkSession, path: str, glob: str = "session-*.json", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usage, prompts) of whole-file sessions, packed: one a line; a prompt's model is the next answer's, even if that is empty."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", not packed).text(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), "value")
    files = (unpacked(files) if packed else files).select("file", F.try_parse_json("value").alias("s")).where("s is not null")
    session = F.coalesce(F.nullif(get("$.sessionId", v="s"), F.lit("")), F.regexp_extract("file", r"session-(.*)\.json$", 1))
    held = files.select("file", session.alias("session"), get("$.messages", "array<variant>", "s").alias("ms"))  # before they part: a message would carry its file along
    messages = held.select("file", "session", F.posexplode("ms").alias("at", "v"))
    n = lambda f: number(f"$.tokens.{f}")
    some = F.greatest(*(n(f) for f in ("input", "output", "cached", "thoughts", "tool"))) > 0
    rows = messages.withColumns({"type": text("$.type"), "ts": F.try_to_timestamp(get("$.timestamp")), "model": text("$.model"), "native_key": F.concat_ws(":", "session", text("$.id")), "some": some, "cwd": F.lit(""), "hint": F.lit(None).cast("string")})
    rows = rows.withColumn("has_usage", F.max((F.col("type") == "gemini") & F.col("some")).over(Window.partitionBy("file"))).withColumn("next", _ahead(F.when(F.col("type") == "gemini", F.col("model"))))
    rows = rows.where(F.col("ts").isNotNull() & (text("$.id") != ""))
    zero = F.lit(0).cast("long")
    measures = {"tok_in": F.greatest(zero, n("input") - n("cached")) + n("tool"), "cache_w": zero, "cache_w1h": zero, "cache_r": n("cached"), "tok_out": n("output") + n("thoughts"), "reasoning": n("thoughts"), "calls": F.lit(1).cast("long")}
    usage = rows.where("type = 'gemini' and some").withColumns(measures).select("file", "native_key", "ts", "session", "model", "cwd", "hint", *MEASURES)
    said = F.coalesce(get("$.content", "array<struct<text:string>>"), F.array(F.struct(get("$.content").alias("text"))))
    prompts = rows.where("type = 'user'").withColumn("text", F.array_join(F.transform(said, lambda b: b["text"]), "\n")).where(r"text rlike '\\S'")
    prompts = prompts.select("file", "native_key", "ts", "session", F.coalesce("next", F.lit("")).alias("model"), "cwd", "text", "has_usage")
    return _named(usage, "google", "gemini-cli"), _named(prompts, "google", "gemini-cli")


def grok(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usage, prompts) of update logs: an event for each model of a turn; chunks in a row make a prompt, a second text begins another."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    about = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").option("wholetext", True).text(path)
    about = about.select(folder(F.col("_metadata.file_path")).alias("dir"), F.try_parse_json("value").alias("s"))
    about = about.select("dir", text("$.info.id", "s").alias("session"), text("$.info.cwd", "s").alias("cwd"), text("$.current_model_id", "s").alias("own_model"), (text("$.parent_session_id", "s") != "").alias("delegated"))
    rows = lines(spark, path, "updates.jsonl").select("file", "at", get("$.params.update", "variant").alias("u"), text("$.params._meta.eventId").alias("event"), get("$.params._meta.agentTimestampMs", "bigint").alias("ms"), get("$.timestamp", "double").alias("s"))
    rows = rows.withColumns({"type": text("$.sessionUpdate", "u"), "ts": F.coalesce(F.when(F.col("ms") > 0, F.timestamp_millis("ms")), F.timestamp_seconds("s")), "named": F.nullif(text("$._meta.modelId", "u"), F.lit(""))})
    chunk, part = F.col("type") == "user_message_chunk", text("$.content.type", "u")
    rows = rows.withColumn("model", _so_far(F.when(chunk, F.col("named"))))
    known = F.broadcast(about) if about.limit(10_001).count() <= 10_000 else about
    with_session = lambda df: df.withColumn("dir", folder(F.col("file"))).join(known, "dir", "left")

    turns = with_session(rows.where("type = 'turn_completed' and event <> ''").where(present("$.usage", "u")))
    kind = "struct<inputTokens:bigint,outputTokens:bigint,cachedReadTokens:bigint,cacheCreationTokens:bigint,reasoningTokens:bigint,modelCalls:bigint>"
    by_model, whole = get("$.usage.modelUsage", f"map<string,{kind}>", "u"), get("$.usage", kind, "u")
    fallback = F.struct(F.coalesce(F.col("model"), "own_model", F.lit("")).alias("key"), whole.alias("value"))
    turns = turns.withColumn("e", F.explode(F.when(F.coalesce(F.size(by_model), F.lit(0)) > 0, F.map_entries(by_model)).otherwise(F.array(fallback))))
    n = lambda f: F.coalesce(F.col(f"e.value.{f}"), F.lit(0))
    measures = {
        "tok_in": F.greatest(F.lit(0), n("inputTokens") - n("cachedReadTokens") - n("cacheCreationTokens")), "cache_w": n("cacheCreationTokens"), "cache_w1h": F.lit(0).cast("long"),
        "cache_r": n("cachedReadTokens"), "tok_out": n("outputTokens"), "reasoning": n("reasoningTokens"), "calls": n("modelCalls"),
    }
    usage = turns.withColumns(measures).withColumn("native_key", F.concat_ws(":", "event", "e.key")).withColumn("hint", F.lit(None).cast("string"))
    usage = usage.select("file", "native_key", "ts", F.coalesce("session", F.lit("")).alias("session"), F.col("e.key").alias("model"), F.coalesce("cwd", F.lit("")).alias("cwd"), "hint", *MEASURES)

    # Islands of chunks: other lines end a message, and so does the next text within one.
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.count_if(~chunk).over(w)).where(chunk).withColumn("is_text", part == "text")
    inside = Window.partitionBy("file", "island").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.count_if(F.col("event") != "").over(inside)).where("open > 0")
    texts_before = F.coalesce(F.count_if("is_text").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("starts", F.col("is_text") & (F.col("event") != "") & (texts_before > 0)).withColumn("message", F.count_if("starts").over(inside))
    shown = F.coalesce(get("$.content._meta.displayText", v="u"), get("$.content.text", v="u"), F.lit(""))
    found = rows.groupBy("file", "island", "message").agg(
        F.min_by("event", "at").alias("native_key"), F.min_by("ts", "at").alias("ts"), F.min_by("named", F.when(F.col("named").isNotNull(), F.col("at"))).alias("model"),
        F.bool_or(F.coalesce(get("$._meta.hideFromScrollback", "boolean", "u"), F.lit(False))).alias("hidden"), F.bool_or(part == "image").alias("image"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_text"), F.struct("at", shown.alias("t"))))), lambda x: x["t"]), "\n").alias("said"),
    )
    shown_text = F.when(F.col("said").rlike(r"\S"), F.col("said")).when(F.col("image"), "[image]")
    prompts = with_session(found.where("not hidden").withColumn("text", shown_text)).where("text is not null and not coalesce(delegated, false)").where(~F.regexp_replace("text", r"^\s+", "").startswith("<system-reminder>"))
    prompts = prompts.select("file", "native_key", "ts", F.coalesce("session", F.lit("")).alias("session"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("cwd", F.lit("")).alias("cwd"), "text", F.lit(True).alias("has_usage"))
    return _named(usage, "xai", "grok-cli"), _named(prompts, "xai", "grok-cli")


def events(usage: DataFrame, key: bytes, machine: str, pv: int = 1, tz_offset_min: int = 0) -> DataFrame:
    """Rows for merge_usage, from a reader's usage; machine reported them, key hides workspaces."""
    provider, source = F.col("provider"), F.col("source")
    return usage.select(
        ids.event_id("usage", provider, source, F.col("native_key")).alias("id"), "provider", "source", "ts", F.lit("event").alias("ts_q"), F.lit(tz_offset_min).cast("long").alias("tz_offset_min"),
        "model", F.lit("").alias("acct"), F.lit("unknown").alias("acct_q"), F.lit("exact").alias("q"), F.lit(pv).cast("long").alias("pv"), ids.session_key(provider, F.col("session")).alias("session"),
        *MEASURES, F.lit(machine).alias("machine"), F.lit("").alias("cc"), F.when(F.col("cwd") == "", "").otherwise(ids.workspace_tag(key, F.col("cwd"))).alias("ws"),
        F.concat_ws("|", "file", "native_key").alias("seq"),
    )
