"""Line dedup by a deletion-neighbourhood join over words, with DataFrame functions only.

A line is its words; lines without words are left alone. A line goes if an earlier one (by doc_id, then row, then line
number) has the same words, or, where both have MIN_WORDS words or more, the same words but for one inserted,
deleted or replaced. So the earliest line of each such neighbourhood stays; what goes is judged on the input, not on
what is left.

Equal lines meet by a digest first and are represented by their earliest. Of two lines one edit apart, one half is
equal in both, so only representatives that share a half with another go on; a half is keyed with the length of the
shorter line. Those emit hashes of the variants with one word of the other half deleted: equal variants without the same
place deleted join a line to a line with one word more, equal variants with the same place deleted join lines that differ
in one word. The earliest line of each variant is found by partial aggregation, so a variant that very many lines share
is no burden, and pairs within it are never made: every line checks its claim against that earliest line only, word
by word. Halves that are shared, and lines that go on, are few among all; they are broadcast only after counting them.

Null and empty texts have no lines. Null doc_ids come first. Rows with the same doc_id are documents of their own, in the
order of a hash of their text; where rows are the same in both, their lines tie, and each row gets the same verdicts.
A line of n words emits some n / 2 hashes, 2 n + 1 at most. Empty tables give no rows. Only doc_id and
text are read; extra columns do not matter.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.chunks import NO_ID
from talliard.llm.common import small, stored
from talliard.tables import table

#: Lines of fewer words match only if they are equal, so that one edit is a fifth of a line at most.
MIN_WORDS = 5

#: What parts words within a line.
BLANKS = "\x20\x09\x0b\x0c\x0d"

#: Halves: the first and last words by the length m of the shorter line, for m = n (own) and m = n - 1.
_HALVES = {
    "h0": f"if(n >= {MIN_WORDS}, xxhash64(n, 0, slice(words, 1, n div 2)), null)",
    "h1": f"if(n >= {MIN_WORDS}, xxhash64(n, 1, slice(words, n div 2 + 1, n)), null)",
    "m0": f"if(n > {MIN_WORDS}, xxhash64(n - 1, 0, slice(words, 1, (n - 1) div 2)), null)",
    "m1": f"if(n > {MIN_WORDS}, xxhash64(n - 1, 1, slice(words, (n - 1) div 2 + 2, n)), null)",
}
_BY_HALF = "stack(4, h0, 0, true, h1, 1, true, m0, 0, false, m1, 1, false) as (half, side, own)"
#: One edit lies on the other side of an equal half: the places where a word is deleted, from low to high.
_LOW, _HIGH = "if(side = 0, (n - if(own, 0, 1)) div 2 + 1, 1)", "if(side = 0, n, n - ((n - if(own, 0, 1)) - (n - if(own, 0, 1)) div 2))"
_VARIANTS = f"""if(role = 'w', array(xxhash64(0L, array_join(words, ' '))), transform(sequence({_LOW}, {_HIGH}),
    i -> xxhash64(if(role = 's', cast(i as bigint), 0L), concat_ws(' ', slice(words, 1, i - 1), slice(words, i + 1, n)))))"""
#: Equal words before the first difference, then what must be equal behind it.
_SAME = "coalesce(nullif(array_position(zip_with(a, b, (x, y) -> x <=> y), false), 0) - 1, least(size(a), size(b)))"
_ONE_EDIT = """case when size(a) = size(b) then slice(a, cast(same as int) + 2, size(a)) = slice(b, cast(same as int) + 2, size(b))
    when size(a) = size(b) + 1 then slice(a, cast(same as int) + 2, size(a)) = slice(b, cast(same as int) + 1, size(a))
    when size(b) = size(a) + 1 then slice(b, cast(same as int) + 2, size(b)) = slice(a, cast(same as int) + 1, size(b))
    else false end"""


def lines_of(docs: DataFrame) -> DataFrame:
    """(place: doc, row and line_no from 0, line) of all lines; a text without lines is a null line 0."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # the hash has a step of its own, else every line would hash its whole text
    rows = docs.select(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = rows.select("doc", "row", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select(F.struct("doc", "row", F.coalesce("line_no", F.lit(0)).alias("line_no")).alias("place"), "line")


def with_words(lines: DataFrame) -> DataFrame:
    """Lines with their words and the number n of these."""
    blanks = F.translate(F.coalesce("line", F.lit("")), BLANKS[1:], "    ")
    return lines.withColumn("words", F.array_remove(F.split(blanks, " "), "")).withColumn("n", F.size("words"))


def _verdicts(docs: DataFrame) -> DataFrame:
    """(place, why) of all lines with a word and of lines 0; why is null for lines that stay, else equal or near."""
    digest = F.unhex(F.md5(F.array_join("words", " ")))
    halves = [F.expr(x).alias(name) for name, x in _HALVES.items()]
    # whether a line has a word is asked of the line, as a filter by n would split it once more
    lines = lines_of(docs).where((F.ltrim(F.col("line"), F.lit(BLANKS)) != "") | (F.col("place.line_no") == 0))
    seen = stored(with_words(lines).select("place", F.when(F.col("n") > 0, digest).alias("digest"), *halves))
    firsts = stored(seen.where("digest is not null").groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("lines"), *(F.first(h).alias(h) for h in _HALVES)))
    by_half = firsts.select("first", F.expr(_BY_HALF)).where("half is not null")
    shared = by_half.groupBy("half").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_more")).where("n_own > 1 or (n_own > 0 and n_more > 0)")
    roles = F.expr("case when own then array_compact(array(if(n_own > 1, 's', null), if(n_more > 0, 'w', null))) when n_own > 0 then array('v') else array() end")
    live = stored(by_half.join(small(stored(shared)), "half").select(F.col("first").alias("place"), "side", "own", F.explode(roles).alias("role")).distinct())
    texts = stored(with_words(lines_of(docs).join(small(live.select("place").distinct()), "place")).select("place", "words", "n").distinct())
    variants = live.join(texts, "place").select("place", "role", F.explode(F.expr(_VARIANTS)).alias("key")).distinct()
    earliest = (
        variants.groupBy("key")
        .agg(*(F.min(F.when(F.col("role") == r, F.col("place"))).alias(r) for r in "wvs"), F.max(F.when(F.col("role") == "s", F.col("place"))).alias("t"))
        .where("s < t or (w is not null and v is not null)")
    )
    partner = F.expr("case role when 'w' then v when 'v' then w else s end")
    claims = variants.join(earliest, "key").select("place", partner.alias("earlier")).where("earlier < place").distinct()
    words = texts.select("place", "words")
    near = (
        claims.join(words.withColumnRenamed("words", "a"), "place")
        .join(words.select(F.col("place").alias("earlier"), F.col("words").alias("b")), "earlier")
        .withColumn("same", F.expr(_SAME)).where(F.expr(_ONE_EDIT)).select(F.col("place").alias("first")).distinct().withColumn("near", F.lit(True))
    )
    # only digests of several lines, or of a line near to another, say anything
    told = firsts.select("digest", "first", "lines").join(small(stored(near)), "first", "left").where("lines > 1 or near").select("digest", "first", "near")
    why = F.when(F.col("first") < F.col("place"), "equal").when(F.col("near"), "near")
    return seen.select("place", "digest").join(small(stored(told)), "digest", "left").select("place", F.col("digest").isNotNull().alias("has_words"), why.alias("why"))


def _doc_id(doc: str):
    return F.when(F.col(doc) != NO_ID, F.col(doc)).alias("doc_id")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, why) of all lines with a word; why is null for lines that stay, else equal or near."""
    return _verdicts(docs).where("has_words").select(_doc_id("place.doc"), "place.line_no", "why")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_equal, n_near, and the removed lines' numbers; a row for each of documents."""
    found = _verdicts(table(spark, sf_dir, "documents")).groupBy("place.doc", "place.row").agg(
        F.count_if(F.col("place.line_no") == 0).alias("rows"), F.count_if("has_words").alias("n_lines"),
        F.count_if(F.col("why") == "equal").alias("n_equal"), F.count_if(F.col("why") == "near").alias("n_near"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("why").isNotNull(), F.col("place.line_no")))).cast("array<string>"), ",").alias("removed"),
    )
    each = [F.expr(f"{c} div rows").alias(c) for c in ("n_lines", "n_equal", "n_near")]
    return found.select(_doc_id("doc"), *each, "removed", F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("_")).drop("_")
