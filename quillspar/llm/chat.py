"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of `>` it begins with. Runs of lines of one
level are passages; a passage is one sequence of normalised words, however its
lines were wrapped. Passages of quotes are hashed by windows of five words (a
shorter one as a whole) and joined to the messages of the conversation that
first wrote those words; the message that gave most windows of the outermost
linked quote is the one replied to. A conversation is then put in reply order
(each thread's root followed by its replies in turn order), and quotes go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.tables import dealt, exclusive_sum, for_each_part, text_or_empty
from quillspar.session import Workspace

#: White space and quote marks at the start of a line. One character class repeated: no recursion in the matcher.
PREFIX = r"^[ \t>]*"
#: A line that only announces the quote under it.
ANNOUNCES = r"(?i)\b(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$"
#: Words of a window; shorter passages are one window.
WINDOW = 5
# Marks between passages and after a passage's level; lines hold neither, for both count as white space.
_CUT, _LEVEL = "\x01", "\x02"


def quote_level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, PREFIX, 0), " \t", ""))


def normalised_line(line: Column) -> Column:
    """Without quote marks, in lower case, white space as one space."""
    bare = F.when(quote_level(line) > 0, F.regexp_replace(line, PREFIX, "")).otherwise(line)
    return F.btrim(F.regexp_replace(F.lower(bare), r"[\x20\x09-\x0D\x01\x02]+", " "), F.lit(" "))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with `passages`, an array of `level` + mark + words in order, `quoted_lines`, and `own`: the text without quotes and announcements."""
    rows = messages.withColumn("_raw", F.split(text_or_empty(text_col), "\n"))
    rows = rows.withColumn("_lines", F.transform("_raw", lambda x: F.struct(x.alias("raw"), quote_level(x).alias("level"), normalised_line(x).alias("said"))))
    none = F.lit(None).cast("int")
    levels = F.transform("_lines", lambda x: x["level"])
    # Neighbours' levels stand beside each line, so that no line looks anything up in the array.
    rows = rows.withColumn("_before", F.concat(F.array(none), F.slice(levels, 1, F.size("_lines") - 1))).withColumn("_after", F.concat(F.slice(levels, 2, F.size("_lines") - 1), F.array(none)))
    rows = rows.withColumn("_lines", F.arrays_zip("_lines", "_before", "_after"))
    new = lambda x: x["_before"].isNull() | (x["_before"] != x["_lines"]["level"])
    marked = F.transform("_lines", lambda x: F.concat(F.when(new(x), F.concat(F.lit(_CUT), x["_lines"]["level"].cast("string"), F.lit(_LEVEL))).otherwise(F.lit(" ")), x["_lines"]["said"]))
    announces = lambda x: x["_lines"]["raw"].rlike(ANNOUNCES) & (F.coalesce(x["_after"], F.lit(0)) > 0)
    own = F.transform(F.filter("_lines", lambda x: (x["_lines"]["level"] == 0) & ~announces(x)), lambda x: x["_lines"]["raw"])
    own = F.regexp_replace(F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")), r"\n[ \t\r\n]*\n", "\n\n")
    quoted = F.size(F.filter("_lines", lambda x: x["_lines"]["level"] > 0)).cast("long")
    passages = F.filter(F.split(F.array_join(marked, ""), _CUT), lambda x: x != "")
    return rows.withColumn("passages", passages).withColumn("own", own).withColumn("quoted_lines", quoted).drop("_raw", "_lines", "_before", "_after")


def _passages(messages: DataFrame, level: Column) -> DataFrame:
    """(conv_id, turn, level, words) of the passages that have words and such a level."""
    rows = messages.select("conv_id", "turn", F.explode("passages").alias("passage"))
    rows = rows.select("conv_id", "turn", F.substring_index("passage", _LEVEL, 1).cast("int").alias("level"), F.filter(F.split(F.substring_index("passage", _LEVEL, -1), " "), lambda w: w != "").alias("words"))
    return rows.where(level & (F.size("words") > 0))


def _windows(passages: DataFrame, size: Column) -> DataFrame:
    """passages with one row for each window of `size` words: `said` and its hash `key`."""
    at = passages.withColumn("_n", size).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("_n") + 1)))
    said = at.withColumn("said", F.array_join(F.slice("words", F.col("_at"), F.col("_n")), " ")).drop("words", "_at", "_n")
    return said.withColumn("key", F.xxhash64("said"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) from parsed messages: one earlier turn for each turn whose outermost linked quotes tell one.

    An original is the first turn of the conversation that has a window's words
    as its own, so a window has one origin at most however often it is said.
    Among the turns that gave a message windows of its lowest linked level, the
    one with most windows is the parent, then the latest.
    """
    space = Workspace(messages.sparkSession)
    quotes = _windows(_passages(messages, F.col("level") > 0), F.least(F.lit(WINDOW), F.size("words")))
    quotes = space.write(quotes, "quotes")
    # Only conversations with quotes are searched, by windows of the sizes that their quotes have.
    sizes = quotes.withColumn("n", F.size(F.split("said", " "))).groupBy("conv_id").agg(F.collect_set("n").alias("sizes"))
    own = dealt(_passages(messages, F.col("level") == 0).where("turn IS NOT NULL"), "turn", "words").alias("o").join(for_each_part(sizes).alias("s"), F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o._part") == F.col("s._part")))
    own = own.select("o.conv_id", "turn", "words", F.explode("sizes").alias("n")).where(F.size("words") >= F.col("n"))
    origins = _windows(own, F.col("n")).groupBy("conv_id", "key", "said").agg(F.min("turn").alias("origin"))
    asked = dealt(quotes.groupBy("conv_id", "turn", "level", "key", "said").agg(F.count("*").alias("n")), "turn").alias("q")
    origins = for_each_part(origins).alias("o")
    same = F.col("q.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("q.key") == F.col("o.key")) & (F.col("q.said") == F.col("o.said")) & (F.col("q._part") == F.col("o._part"))
    found = asked.join(origins, same).where("origin < turn").select("q.conv_id", "turn", "level", "n", "origin")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), "n", "origin"))
    return votes.groupBy("conv_id", "turn").agg(best["origin"].alias("parent_turn"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn): parents are followed by doubling, in as many rounds as the longest chain has bits."""
    space = Workspace(links.sparkSession)
    roots = space.write(links.withColumn("root_turn", F.col("parent_turn")), "roots0")
    turn = 0
    while True:
        above = for_each_part(roots.select("conv_id", F.col("turn").alias("at"), F.col("root_turn").alias("above"))).alias("a")
        below = dealt(roots, "turn").alias("b")
        roots = below.join(above, F.col("b.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("root_turn") == F.col("at")) & (F.col("b._part") == F.col("a._part")), "left")
        roots = roots.select("b.conv_id", "turn", "parent_turn", "root_turn", "above")
        turn += 1
        roots = space.write(roots, f"step{turn}")
        if roots.where("above IS NOT NULL").isEmpty():
            return roots.drop("above")
        roots = roots.select("conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, parent_turn, root_turn, position, quoted_lines, text (without quotes), formatted.

    position counts from 0 in each conversation's reply order. A message whose
    quotes link to no earlier turn has a null parent and is a root; its quotes
    go all the same. A null or empty text, or one of quotes only, is an empty
    message; a null conversation is one conversation, linked as any other, and
    a null turn stands first, links to none and is never replied to. Rows that
    repeat a turn follow each other, in the order of role and text, and share
    their parent. A null role is written `unknown`. Runs of blank lines become
    one. Texts are read whole, whatever their lines; other columns are not read.
    """
    space = Workspace(conversations.sparkSession)
    messages = space.write(parsed(conversations.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "own", "passages", "quoted_lines"), "parsed")
    roots = space.write(thread_roots(space.write(reply_links(messages), "links")), "roots").alias("r")
    threads = messages.select("conv_id", "turn", "role", "own", "quoted_lines").alias("m").join(roots, F.col("m.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("m.turn") == F.col("r.turn")), "left")
    threads = threads.select("m.conv_id", "m.turn", "role", "own", "quoted_lines", "parent_turn", F.coalesce("root_turn", "m.turn").alias("root_turn"))
    # Sorted by ranges of all columns: a long conversation or thread lies in several, each numbers its own rows, and
    # the ranges' counts tell where it begins.
    order = ["conv_id", "root_turn", "turn", "role", "own", "quoted_lines"]
    ranged = threads.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = space.write(ranged, "ranged")
    starts = exclusive_sum(ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n")), ["conv_id"], ["range"], "n", "before").drop("n").alias("s")
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:]))).alias("t")
    placed = placed.join(starts, F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("t.range") == F.col("s.range")))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    return placed.select("t.conv_id", "turn", "role", "parent_turn", "root_turn", (F.col("before") + F.col("place") - 1).cast("long").alias("position"), "quoted_lines", F.col("own").alias("text"), formatted.alias("formatted"))


#: The same in SQL, from the raw table.
REPLY_ORDERED_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS m, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), lines AS (
  SELECT m, conv_id, turn, role, i, ls[i] AS line, length(regexp_replace(regexp_extract(ls[i], '^[ \t>]*', 0), '[ \t]', '', 'g')) AS level
  FROM (SELECT m, conv_id, turn, role, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), marked AS (
  SELECT *, trim(regexp_replace(lower(CASE WHEN level > 0 THEN regexp_replace(line, '^[ \t>]*', '') ELSE line END), '[\x20\x09-\x0D\x01\x02]+', ' ', 'g'), ' ') AS said,
         coalesce(lag(level) OVER w <> level, true) AS fresh,
         level = 0 AND coalesce(lead(level) OVER w, 0) > 0 AND regexp_matches(line, '(?i)\b(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$') AS announces
  FROM lines WINDOW w AS (PARTITION BY m ORDER BY i)
), own AS (
  SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, count(*) FILTER (level > 0) AS quoted_lines,
         regexp_replace(trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT announces), ''), ' ' || chr(9) || chr(13) || chr(10)),
                        '\n[ \t\r\n]*\n', chr(10) || chr(10), 'g') AS text
  FROM marked GROUP BY m
), runs AS (
  SELECT *, sum(fresh::int) OVER (PARTITION BY m ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked
), passages AS (
  SELECT any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level, list_filter(string_split(string_agg(said, ' ' ORDER BY i), ' '), lambda x: x <> '') AS words
  FROM runs GROUP BY m, run
), quotes AS (
  SELECT conv_id, turn, level, least(5, len(words)) AS n, array_to_string(words[p:p + least(5, len(words)) - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS p FROM passages WHERE level > 0 AND len(words) > 0)
), sizes AS (
  SELECT DISTINCT conv_id, n FROM quotes
), origins AS (
  SELECT conv_id, said, min(turn) AS origin FROM (
    SELECT conv_id, turn, array_to_string(words[p:p + n - 1], ' ') AS said
    FROM (SELECT a.conv_id, turn, words, n, unnest(range(1, len(words) - n + 2)) AS p
          FROM passages a JOIN sizes s ON a.conv_id IS NOT DISTINCT FROM s.conv_id WHERE level = 0 AND turn IS NOT NULL AND len(words) >= n))
  GROUP BY conv_id, said
), votes AS (
  SELECT q.conv_id, q.turn, q.level, o.origin, count(*) AS n
  FROM quotes q JOIN origins o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.said = o.said
  WHERE o.origin < q.turn GROUP BY ALL
), parents AS (
  SELECT conv_id, turn, origin AS parent_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1
), roots AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS hops FROM parents
  UNION ALL
  SELECT r.conv_id, r.turn, p.parent_turn, hops + 1 FROM roots r JOIN parents p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.turn = r.root_turn
), tops AS (
  SELECT conv_id, turn, arg_max(root_turn, hops) AS root_turn FROM roots GROUP BY conv_id, turn
)
SELECT o.conv_id, o.turn, o.role, p.parent_turn, coalesce(t.root_turn, o.turn) AS root_turn,
       row_number() OVER (PARTITION BY o.conv_id ORDER BY coalesce(t.root_turn, o.turn) NULLS FIRST, o.turn NULLS FIRST, o.role NULLS FIRST, o.text, o.quoted_lines) - 1 AS position,
       o.quoted_lines, o.text, '<|' || coalesce(o.role, 'unknown') || '|>' || chr(10) || o.text || chr(10) AS formatted
FROM own o LEFT JOIN parents p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.turn = o.turn LEFT JOIN tops t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.turn = o.turn
"""
