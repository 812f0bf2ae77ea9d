"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines have a quote level, the number of leading ``>`` signs.
Consecutive lines of one level above 0 are a quoted passage.  Passages and
their lines are normalised and hashed, and so are the bodies, paragraphs and
lines that messages themselves say.  A message replies to the one that it
quotes most at the lowest level that is found anywhere: what is nested deeper
was quoted by that one already.  Following replies to their start gives each
message its thread and depth, and the quotes themselves are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: A line before a quote that only says who wrote it.
ATTRIBUTION = r"(?i)^\s*(on\b.*|.*)\b(wrote|schrieb|écrit|escribió)\s*:\s*$"
_MARK = r"^((?:[ \t]*>)+)[ \t]?"


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Adds body string (what the message itself says) and passages array<struct<level,lines>> to rows with ``text``.

    Messages without a ``>`` at the start of a line, most of them, aren't cut
    into lines.  The others are written as they were cut: left to the optimizer,
    filters on passages would cut a text anew for each of its lines.
    """
    quoted = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    ends = lambda c: F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    plain = messages.where(~quoted).withColumn("body", ends(F.coalesce("text", F.lit("")))).withColumn("passages", F.array().cast("array<struct<level:int,lines:array<string>>>"))
    rows = messages.where(quoted).withColumn("_lines", F.split("text", "\r\n|\r|\n"))
    mark = lambda x: F.regexp_extract(x, _MARK, 1)
    line = lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("text"))
    rows = rows.withColumn("_lines", F.transform("_lines", line))
    at = lambda i: F.get("_lines", i)
    # places at which a run of lines of one level begins
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    rows = rows.withColumn("_starts", F.filter(places, lambda i: (i == 0) | (at(i)["level"] != at(i - 1)["level"])))
    stop = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    run = lambda s, k: F.struct(at(s)["level"].alias("level"), F.transform(F.slice("_lines", s + 1, stop(k) - s), lambda x: x["text"]).alias("lines"))
    rows = rows.withColumn("_runs", F.transform("_starts", run))
    own = F.filter("_lines", lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(at(i + 1)["level"], F.lit(0)) > 0)))
    body = F.array_join(F.transform(own, lambda x: x["text"]), "\n")
    rows = rows.withColumn("body", ends(F.regexp_replace(body, r"\n{3,}", "\n\n")))
    passages = F.filter("_runs", lambda r: (r["level"] > 0) & F.exists(r["lines"], lambda x: F.trim(x) != ""))
    cut = stored(rows.withColumn("passages", passages).drop("_lines", "_starts", "_runs"), "quoted")
    return cut.unionByName(plain)


def _units(text: Column) -> Column:
    """The normal forms of a text, its paragraphs and its lines, without repeats and empty ones."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))


def link_quotes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): for each message that quotes an earlier one, the one that it answers.

    Rows are those of ``parse_quotes``.  What several messages say belongs to
    the first of them, so a unit has one origin in a conversation, found by a
    partial aggregate.  Of the lowest level at which a message quotes an
    earlier one, the origin quoted most is the parent; ties go to the later.
    """
    heard = rows.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p"))
    heard = heard.select("conv_id", "turn", "p.level", F.explode(_units(F.array_join("p.lines", "\n"))).alias("unit"))
    heard = heard.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn", F.sha2("unit", 256).alias("hash")).agg(F.min("level").alias("level"), F.max(F.length("unit")).alias("weight"))
    said = rows.select("conv_id", "turn", "body").join(heard.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("unit"))
    said = said.groupBy("conv_id", F.sha2("unit", 256).alias("hash")).agg(F.min("turn").alias("origin"))
    met = heard.join(said, ["conv_id", "hash"]).where("origin < turn")
    met = met.groupBy("conv_id", "turn", "origin", "level").agg(F.sum("weight").alias("weight"))
    met = met.groupBy("conv_id", "turn", "origin").agg(F.max(F.struct(-F.col("level"), "weight")).alias("m"))
    best = met.groupBy("conv_id", "turn").agg(F.max(F.struct("m", "origin")).alias("m"), F.count("*").alias("n_linked"))
    return best.select("conv_id", "turn", F.col("m.origin").alias("parent_turn"), "n_linked")


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth): where the replies above a message begin and how many there are; doubles the reach in each round."""
    state = links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.col("parent_turn").alias("top"), F.lit(1).alias("depth"))
    while True:
        above = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"))
        joined = state.join(above, (state["conv_id"] == above["_c"]) & (state["up"] == above["_t"]), "left")
        state = stored(joined.select("conv_id", "turn", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "threads")
        if not state.where("up is not null").take(1):
            break
    return state.select("conv_id", "turn", F.col("top").alias("thread_turn"), "depth")


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per message: conversations in reply order, without quotes.

    ``messages`` has conv_id and turn (integers), role and text (strings);
    other columns are not used, whatever their names.  Returns conv_id long,
    turn long, role string, content string, n_quotes int (quoted passages),
    n_linked int (messages quoted), parent_turn long (null where nothing is
    quoted), thread_turn long (the turn that starts the thread), depth int (its
    replies down to the message) and formatted string.  Ordering by (conv_id,
    thread_turn, turn) puts every thread together and every reply behind what
    it answers; a row's size does not grow with its thread.

    Null text has empty content; null role is 'unknown'.  A message with a null
    conv_id or turn is linked with nothing.  Rows that repeat a turn are each
    returned, with the links of their turn; where several messages say the
    same, the smallest turn is quoted.  Texts of any length are cut in place.
    An empty table gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), "text")
    rows = parse_quotes(rows)
    links = stored(link_quotes(rows), "quote-links")
    out = rows.select("conv_id", "turn", "role", F.col("body").alias("content"), F.size("passages").alias("n_quotes"))
    if links.take(1):
        out = out.join(links.join(_threads(links), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    else:
        out = out.withColumns({"parent_turn": F.lit(None).cast("long"), "n_linked": F.lit(None).cast("long"), "thread_turn": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("int"), "thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    out = out.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("<|end|>\n")))
    return out.select("conv_id", "turn", "role", "content", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth", "formatted")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# Holds for messages of any text: lines, levels, passages and bodies are cut in
# SQL; links and paths follow by recursion.
OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER () AS id FROM conversations
), q AS (
  SELECT *, regexp_matches(text, '(^|\n)[ \t]*>') AS quoted FROM m
), l AS (
  SELECT id, i, ls[i] AS x FROM (SELECT id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM q WHERE quoted), unnest(range(1, len(ls) + 1)) AS t(i)
), lv AS (
  SELECT id, i, len(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') AS x FROM l
), nx AS (
  SELECT *, coalesce(lead(level) OVER w, 0) AS next, CASE WHEN coalesce(lag(level) OVER w, -1) <> level THEN 1 ELSE 0 END AS new FROM lv WINDOW w AS (PARTITION BY id ORDER BY i)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM nx
), pass AS (
  SELECT id, run, min(level) AS level, string_agg(x, chr(10) ORDER BY i) AS p FROM runs WHERE level > 0 GROUP BY id, run HAVING bool_or(trim(x) <> '')
), own AS (
  SELECT id, string_agg(x, chr(10) ORDER BY i) AS b FROM runs
  WHERE level = 0 AND NOT (regexp_matches(x, '(?i)^\s*(on\b.*|.*)\b(wrote|schrieb|écrit|escribió)\s*:\s*$') AND next > 0) GROUP BY id
), body AS (
  SELECT q.id, conv_id, turn, role, regexp_replace(CASE WHEN quoted THEN regexp_replace(coalesce(b, ''), '\n{3,}', chr(10) || chr(10), 'g') ELSE text END, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS content FROM q LEFT JOIN own USING (id)
), heard AS (
  SELECT conv_id, turn, u, min(level) AS level FROM (
    SELECT conv_id, turn, level, unnest(list_concat([p], string_split_regex(p, '\n\s*\n'), string_split(p, chr(10)))) AS r FROM pass JOIN m USING (id)
  ), LATERAL (SELECT trim(regexp_replace(lower(r), '\s+', ' ', 'g')) AS u) WHERE u <> '' GROUP BY conv_id, turn, u
), said AS (
  SELECT conv_id, u, min(turn) AS origin FROM (
    SELECT conv_id, turn, unnest(list_concat([content], string_split_regex(content, '\n\s*\n'), string_split(content, chr(10)))) AS r FROM body WHERE conv_id IN (SELECT conv_id FROM heard)
  ), LATERAL (SELECT trim(regexp_replace(lower(r), '\s+', ' ', 'g')) AS u) WHERE u <> '' GROUP BY conv_id, u
), met AS (
  SELECT conv_id, turn, origin, level, sum(len(u)) AS w FROM heard JOIN said USING (conv_id, u) WHERE origin < turn GROUP BY conv_id, turn, origin, level
), link AS (
  SELECT conv_id, turn, first(origin ORDER BY level, w DESC, origin DESC) AS parent, count(DISTINCT origin) AS n FROM met GROUP BY conv_id, turn
), path AS (
  SELECT DISTINCT conv_id, turn, turn AS root, 0 AS depth FROM m WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.conv_id = m.conv_id AND link.turn = m.turn)
  UNION ALL SELECT link.conv_id, link.turn, path.root, path.depth + 1 FROM link JOIN path ON path.conv_id = link.conv_id AND path.turn = link.parent
)
SELECT b.conv_id, b.turn, role, content, coalesce((SELECT count(*) FROM pass WHERE pass.id = b.id), 0)::INTEGER AS n_quotes, coalesce(n, 0)::INTEGER AS n_linked,
  parent AS parent_turn, coalesce(root, b.turn) AS thread_turn, coalesce(depth, 0)::INTEGER AS depth,
  '<|' || role || '|>' || chr(10) || content || '<|end|>' || chr(10) AS formatted
FROM body b LEFT JOIN link USING (conv_id, turn) LEFT JOIN path USING (conv_id, turn)
"""
