"""Quality rules: line-first cleaning, with DataFrame functions only and no shuffle.

Every line is judged by itself: by punctuation (symbols make up much of it, or an exclamation after most words, or
a stub of a few words without an end mark), by navigation (a bar between most words), and by boilerplate (a short
line with a fixed phrase). Failing lines go; a document that keeps less than half of its word characters is
rejected. Apart from that stand the base counts: words, symbols, repeated lines, and words in three-word windows
found more than once.

Repeated windows are found within the row: windows are packed as hash bits and position into one long, sorted, and
neighbours compared. Equal hashes are compared by their words too; where hashes collide, as they do in texts of millions
of words, the windows with equal hashes are sorted by their words instead. So the count is exact, and the time n log n.

Null and empty texts have zero counts, are base_failed and not kept. Ties, repeated rows and extra columns do not
matter, as each row is judged by itself; columns whose names clash with a result are replaced. An empty table
gives an empty result. A text of any length is one row's work: its words and windows are in memory, some hundred bytes
each.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.common import WORD
from talliard.tables import table

#: Phrases that mark a short line as boilerplate.
PHRASES = ["all rights reserved", "cookie", "terms of use", "privacy policy", "enable javascript", "copyright ©", "subscribe to our newsletter", "click here", "sign up now"]

MIN_WORDS = 50
#: A line fails with this share of symbols among its word characters.
SYMBOL_SHARE = 0.1
#: A line fails with a bar for this share of its words, from three bars on.
BAR_SHARE = 0.25
#: A line with a boilerplate phrase fails up to this many words.
BOILERPLATE_WORDS = 40
#: A line without an end mark fails below this many words.
STUB_WORDS = 3
#: A document is rejected if it keeps less than this share of its word characters.
KEPT_SHARE = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _line_passes(line: str) -> str:
    """SQL for one line: true for lines without a word and for those that no rule fails. Counts are made once, the costly ones where a plain search finds something."""
    chars = f"length(regexp_replace({line}, '[\\\\x20\\\\x09-\\\\x0D]+', ''))"
    words = f"regexp_count({line}, '[^\\\\x20\\\\x09-\\\\x0D]+')"
    symbols = "length(regexp_replace(y.t, '[^#*$%&|<>]+', ''))"
    phrases = " or ".join(f"contains(l, '{p}')" for p in PHRASES)
    return f"""exists(array(named_struct('t', {line}, 'c', {chars}, 'w', {words})), y -> y.c = 0 or not (
        {symbols} >= {SYMBOL_SHARE} * y.c
        or (contains(y.t, '!!') and 2 * regexp_count(y.t, '!!') >= y.w)
        or (contains(y.t, '|') and regexp_count(y.t, '[|]') >= 3 and regexp_count(y.t, '[|]') >= {BAR_SHARE} * y.w)
        or (y.w <= {BOILERPLATE_WORDS} and exists(array(lower(y.t)), l -> {phrases}))
        or (y.w < {STUB_WORDS} and not y.t rlike '[.!?…:;"»”)]\\\\s*$')))"""


_EQUAL = " and ".join(f"get(_words, cast((x & _mask) + {i} as int)) = get(_words, cast((get(_dup, j - 1) & _mask) + {i} as int))" for i in range(3))
_HASH = "xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))"
_OWN = "transform(_dup, x -> cast(x & _mask as int))"
_BY_WORDS = f"sort_array(transform({_OWN}, p -> struct(get(_words, p) as a, get(_words, p + 1) as b, get(_words, p + 2) as c, p as p)))"
_NEXT = "x.a = get(_by_words, {j}).a and x.b = get(_by_words, {j}).b and x.c = get(_by_words, {j}).c"


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts."""
    return (
        docs.drop(*(set(COUNTS) & set(docs.columns)))
        .withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        .withColumn("n_words", F.size("_words"))
        .withColumns({
            "word_chars": F.expr("cast(length(regexp_replace(_text, '[\\\\x20\\\\x09-\\\\x0D]+', '')) as long)"),
            "n_symbols": F.expr("cast(length(regexp_replace(_text, '[^#*$%&|<>]+', '')) as long)"),
            "_lines": F.expr("filter(split(_text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
            "_bits": F.expr("length(bin(n_words))"),
        })
        .withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"))
        .withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1L"))
        .withColumn("_keys", F.expr(f"transform(if(n_words < 3, cast(array() as array<int>), sequence(0, n_words - 3)), i -> shiftleft({_HASH}, _bits) | i)"))
        .withColumn("_sorted", F.sort_array("_keys"))
        .withColumn("_dup", F.expr("filter(_sorted, (x, j) -> (j > 0 and (x & ~_mask) = (get(_sorted, j - 1) & ~_mask)) or (x & ~_mask) = coalesce(get(_sorted, j + 1) & ~_mask, ~x))"))
        .withColumn("_clash", F.expr(f"size(filter(_dup, (x, j) -> j > 0 and (x & ~_mask) = (get(_dup, j - 1) & ~_mask) and not ({_EQUAL}))) > 0"))
        .withColumn("_by_words", F.expr(f"case when _clash then {_BY_WORDS} end"))
        .withColumn("_same", F.expr(f"filter(_by_words, (x, j) -> coalesce(j > 0 and {_NEXT.format(j='j - 1')}, false) or coalesce({_NEXT.format(j='j + 1')}, false))"))
        .withColumn("_at", F.sort_array(F.expr(f"case when _clash then transform(_same, x -> x.p) else {_OWN} end")))
        .withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (a, x) -> a + x)"))
        .withColumn("n_words", F.col("n_words").cast("long"))
        .drop("_text", "_words", "_lines", "_bits", "_mask", "_keys", "_sorted", "_dup", "_clash", "_by_words", "_same", "_at")
    )


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with cleaned (the text without failing lines), n_failed_lines and kept_chars (word characters left)."""
    return (
        docs.drop(*({"cleaned", "n_failed_lines", "kept_chars"} & set(docs.columns)))
        .withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
        .withColumn("_pass", F.expr(f"filter(_lines, x -> {_line_passes('x')})"))
        .withColumn("cleaned", F.when(F.col(text).isNotNull(), F.array_join("_pass", "\n")))
        .withColumn("n_failed_lines", (F.size("_lines") - F.size("_pass")).cast("long"))
        .withColumn("kept_chars", F.expr("cast(coalesce(length(regexp_replace(cleaned, '[\\\\x20\\\\x09-\\\\x0D]+', '')), 0) as long)"))
        .drop("_lines", "_pass")
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, cleaned, n_failed_lines, kept_chars and kept."""
    found = clean_lines(base_counts(docs, text), text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_chars") >= KEPT_SHARE * F.col("word_chars")))


def kept_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with the cleaned text, and the columns of docs; n_chars follows the text.

    Explode drops the rejected rows: a filter would be pushed below, where Spark repeats all expressions behind kept
    for each use and does not finish planning.
    """
    found = judge(docs, text).withColumn("_kept", F.explode(F.expr("if(kept, array(true), array())"))).withColumn(text, F.col("cleaned"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text).cast("long"))
    return found.select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "n_failed_lines", "kept_chars")


_SQL_WORDS = r"'[^\x20\x09-\x0D]+'"
_SQL_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"


def _sql_passes(line: str) -> str:
    chars, words = _SQL_CHARS.format(line), f"len(regexp_extract_all({line}, {_SQL_WORDS}))"
    count = lambda p: f"len(regexp_extract_all({line}, '{p}'))"
    phrases = " or ".join(f"contains(lower({line}), '{p}')" for p in PHRASES)
    return f"""({chars} = 0 or not (length(regexp_replace({line}, '[^#*$%&|<>]+', '', 'g')) >= {SYMBOL_SHARE} * {chars}
      or 2 * {count('!!')} >= {words} or ({count('[|]')} >= 3 and {count('[|]')} >= {BAR_SHARE} * {words})
      or ({words} <= {BOILERPLATE_WORDS} and ({phrases}))
      or ({words} < {STUB_WORDS} and not regexp_matches({line}, '[.!?…:;"»”)]\\s*$'))))"""


OP1_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_SQL_WORDS}) as w from documents),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
pos as (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d where len(w) >= 3),
win as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from pos),
hit as (select distinct doc_id, i + k as i from win, range(0, 3) r(k) where c > 1),
rep as (select doc_id, count(*) as n from hit group by doc_id),
b as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast({_SQL_CHARS.format('t')} as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    string_split(t, chr(10)) as al, list_filter(string_split(t, chr(10)), lambda x: {_sql_passes('x')}) as pl
  from d join lines on d.doc_id = lines.doc_id left join rep on rep.doc_id = d.doc_id),
c as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, cast(len(al) - len(pl) as bigint) as n_failed_lines,
    cast({_SQL_CHARS.format("coalesce(array_to_string(pl, chr(10)), '')")} as bigint) as kept_chars from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and kept_chars >= {KEPT_SHARE} * word_chars as kept, n_failed_lines, kept_chars from c
"""
