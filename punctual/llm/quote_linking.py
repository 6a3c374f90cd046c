"""Chat formatting by quotation linking, on DataFrame functions only.

Lines that begin with > are quotes, as deep as they have such marks. Runs of quoted lines of one depth
are passages. Passages of every depth and, for quotes that were cut, their lines are normalised and
hashed, and joined to what earlier messages of the conversation say in their own words: as a whole, by
paragraph, by line and by sentence. A message answers the latest earlier message that says what it
quotes at the least depth. Its thread begins with the first message on the way back that quotes
nothing known, and its place in the thread is that in reply order: after its parent and before its
parent's later answers. Quotes and the lines that announce them leave the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import let, written

PREFIX = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Turns that are searched at once for the latest earlier one; before that only each span's last counts.
SPAN = 1024


def normal(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def depth(line: Column) -> Column:
    """How many marks a line begins with."""
    prefix = F.regexp_extract(line, PREFIX, 0)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))


def split_quotes(messages: DataFrame, *, text: str = "text") -> DataFrame:
    """`messages` with body (own text) and passages (array of depth and lines). Null texts have an empty body."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    parsed = F.transform(lines, lambda x: F.struct(depth(x).alias("depth"), F.when(depth(x) > 0, F.trim(F.regexp_replace(x, PREFIX, ""))).otherwise(x).alias("line")))

    def own(p: Column) -> Column:
        announced = lambda x, i: x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get(p, i + 1)["depth"], F.lit(0)) > 0)
        kept = F.filter(p, lambda x, i: (x["depth"] == 0) & ~announced(x, i))
        return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")

    def passages(p: Column) -> Column:
        placed = F.transform(p, lambda x, i: F.struct(x["depth"].alias("depth"), i.alias("i")))
        other = lambda x, k: F.coalesce(F.get(p, x["i"] + k)["depth"], F.lit(0)) != x["depth"]
        first = F.filter(placed, lambda x: (x["depth"] > 0) & other(x, -1))
        last = F.filter(placed, lambda x: (x["depth"] > 0) & other(x, 1))
        cut = lambda a, b: F.struct(a["depth"].alias("depth"), F.transform(F.slice(p, a["i"] + 1, b["i"] - a["i"] + 1), lambda x: x["line"]).alias("lines"))
        return F.zip_with(first, last, cut)

    both = let(parsed, lambda p: F.struct(own(p).alias("body"), passages(p).alias("passages")))
    found = messages.withColumn("_split", both)
    kept = [c for c in messages.columns if c not in ("body", "passages")]
    return found.select(*kept, "_split.body", "_split.passages")


def _keys(said: Column) -> list[Column]:
    """Two hashes: together 128 bits, so that equal ones mean equal texts."""
    return [F.xxhash64(said).alias("h1"), F.xxhash64(F.lit(1), said).alias("h2")]


def originals(parsed: DataFrame) -> DataFrame:
    """conv_id, h1, h2, turn: what the messages say themselves, as a whole, by paragraph, by line and by sentence."""
    whole = normal(F.col("body"))
    parts = F.transform(F.split(F.col("body"), r"\n[ \t]*\n"), normal)
    lines = F.transform(F.split(F.col("body"), "\n"), normal)
    sentences = F.split(F.regexp_replace(whole, r"([.!?])\x20", "$1\n"), "\n")
    rows = parsed.where("turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array(whole), parts, lines, sentences))).alias("said")).where("said != ''")
    return rows.select("conv_id", "turn", *_keys(F.col("said"))).distinct()


def quotes(quoting: DataFrame) -> DataFrame:
    """conv_id, turn, depth, whole (1 for a passage, 0 for one of its lines or sentences), h1, h2 of all that is quoted.

    A passage is put together from its lines before it is cut into sentences, so these are found however the lines are wrapped.
    """
    at = quoting.where("turn is not null").select("conv_id", "turn", F.explode("passages").alias("p"))
    passage = F.struct(F.lit(1).alias("whole"), normal(F.array_join("p.lines", " ")).alias("said"))
    single = F.transform(F.transform(F.col("p.lines"), normal), lambda x: F.struct(F.lit(0).alias("whole"), x.alias("said")))
    cut = F.split(F.regexp_replace(passage["said"], r"([.!?])\x20", "$1\n"), "\n")
    sentences = F.transform(cut, lambda x: F.struct(F.lit(0).alias("whole"), x.alias("said")))
    found = at.select("conv_id", "turn", "p.depth", F.explode(F.concat(F.array(passage), single, sentences)).alias("q")).where("q.said != ''")
    return found.select("conv_id", "turn", "depth", "q.whole", *_keys(F.col("q.said"))).distinct()


def parents(quoting: DataFrame, known: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn for messages that quote something known: the least depth counts first, then whole passages before lines, then the latest message.

    What is quoted often meets what is said often in no join: the latest earlier turn is a window's
    running maximum. Turns are dealt to spans, and of the spans before only the last turn is carried.
    """
    asked, key = quotes(quoting), ["conv_id", "h1", "h2"]
    said = known.join(asked.select(*key).distinct(), key, "left_semi")
    none = F.lit(None).cast(known.schema["turn"].dataType)
    rows = asked.withColumn("said", none).unionByName(said.withColumns({"depth": F.lit(None).cast("int"), "whole": F.lit(None).cast("int"), "said": F.col("turn")}))
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    near = F.max("said").over(Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy(*key, "span").agg(F.max("said").alias("last"))
    carried = spans.withColumn("before", F.max("last").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    found = rows.withColumn("near", near).where("depth is not null").join(carried, [*key, "span"]).withColumn("first", F.coalesce("near", "before")).where("first is not null")
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "whole", "first")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.first").alias("parent_turn"))


def threads(edges: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn: where going from parent to parent ends. Each round doubles the way."""
    now = written(edges.withColumn("thread_turn", F.col("parent_turn")).withColumn("going", F.lit(True)), "threads")
    for _ in range(most_rounds):
        if now.where("going").isEmpty():
            return now.drop("going")
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_next"))
        further = now.join(up, ["conv_id", "thread_turn"], "left")
        now = written(further.select("conv_id", "turn", "parent_turn", F.coalesce("_next", "thread_turn").alias("thread_turn"), F.col("_next").isNotNull().alias("going")), "threads")
    raise RuntimeError(f"threads are longer than 2^{most_rounds} messages")


def positions(edges: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """conv_id, turn, reply_position of the edges' messages (conv_id, turn, parent_turn, thread_turn): how many come before it in its thread.

    A walk around each thread's tree goes down to a message, through its answers in the order of
    their turns, and up again. Counting backwards how many messages each step of the walk still has
    before it, by doubling, gives every message's place without gathering a thread anywhere.
    """
    order = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    sides = edges.withColumn("sibling", F.lead("turn").over(order))
    roots = edges.select("conv_id", F.col("thread_turn").alias("turn")).distinct()
    none = F.lit(None).cast(edges.schema["turn"].dataType)
    all_ = sides.select("conv_id", "turn", "parent_turn", "sibling").unionByName(roots.withColumns({"parent_turn": none, "sibling": none}))
    first = edges.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    tree = all_.join(first, ["conv_id", "turn"], "left")
    step = lambda side, to, to_side, n: F.struct(F.lit(side).alias("up"), to.alias("to"), to_side.alias("to_up"), F.lit(n).cast("long").alias("left"))
    child, sibling = F.col("child").isNotNull(), F.col("sibling").isNotNull()
    down = step(False, F.coalesce("child", "turn"), ~child, 1)
    up = step(True, F.coalesce("sibling", "parent_turn"), ~sibling, 0)
    now = written(tree.select("conv_id", "turn", F.explode(F.array(down, up)).alias("s")).select("conv_id", "turn", "s.*"), "walk")
    for _ in range(most_rounds):
        if now.where("to is not null").isEmpty():
            break
        after = now.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("_to"), F.col("to_up").alias("_up"), F.col("left").alias("_left"))
        further = now.join(after, ["conv_id", "to", "to_up"], "left")
        now = written(further.select("conv_id", "turn", "up", F.col("_to").alias("to"), F.col("_up").alias("to_up"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "walk")
    left = now.where("not up").select("conv_id", "turn", "left")
    whole = left.select("conv_id", F.col("turn").alias("thread_turn"), F.col("left").alias("size"))
    return edges.join(left, ["conv_id", "turn"]).join(whole, ["conv_id", "thread_turn"]).select("conv_id", "turn", (F.col("size") - F.col("left")).alias("reply_position"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_passages, parent_turn, thread_turn, reply_position, chat of every message.

    In reply order a conversation is sorted by thread_turn, then reply_position. parent_turn is null
    for a message that quotes nothing known; its thread begins with itself, at position 0. Messages
    with a null conv_id or turn are linked to none. Repeated rows stay, each with the same link; of
    different messages with one turn all that quote share one parent. Other columns are ignored.
    """
    own = messages.select("conv_id", "turn", "role", "text")
    has = F.coalesce(F.col("text").rlike("(?m)" + PREFIX), F.lit(False))
    parsed = split_quotes(own.withColumn("_quotes", has))
    # only conversations with quotes need an index of what was said
    quoting = parsed.where("_quotes")
    where = quoting.select("conv_id").distinct()
    known = originals(parsed.join(where, "conv_id", "left_semi"))
    edges = threads(written(parents(quoting, known), "parents"))
    edges = edges.join(positions(edges), ["conv_id", "turn"])
    alone = {"parent_turn": F.lit(None).cast(messages.schema["turn"].dataType), "thread_turn": F.col("turn"), "reply_position": F.lit(0).cast("long")}
    plain = parsed.where(~F.col("_quotes")).withColumns(alone)
    answered = quoting.join(edges, ["conv_id", "turn"], "left").withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "reply_position": F.coalesce("reply_position", F.lit(0).cast("long"))})
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))
    out = plain.unionByName(answered)
    return out.select("conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_passages"), "parent_turn", "thread_turn", "reply_position", chat.alias("chat"))


#: The same over all conversations as SQL.
SQL = r"""
WITH RECURSIVE msg AS MATERIALIZED (SELECT row_number() OVER () AS m, conv_id, turn, role, text FROM conversations),
parsed AS (SELECT m, i, length(p) - length(replace(p, '>', '')) AS depth, CASE WHEN p = '' THEN x ELSE trim(substr(x, length(p) + 1), ' ') END AS x
  FROM (SELECT m, i, x, regexp_extract(x, '^(?:[ \t]*>)+') AS p FROM (SELECT m, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM msg))),
marked AS (SELECT *, lead(depth, 1, 0) OVER (PARTITION BY m ORDER BY i) AS after, lag(depth, 1, 0) OVER (PARTITION BY m ORDER BY i) AS before FROM parsed),
body AS (SELECT m, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM marked
  WHERE depth = 0 AND NOT (after > 0 AND regexp_matches(x, '(?i)(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')) GROUP BY m),
run AS (SELECT *, sum(CASE WHEN depth <> before THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY i) AS r FROM marked),
passage AS (SELECT m, r, any_value(depth) AS depth, string_agg(x, ' ' ORDER BY i) AS said FROM run WHERE depth > 0 GROUP BY m, r),
norm AS (SELECT m, lower(trim(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS s FROM body),
said AS (
  SELECT m, s FROM norm UNION ALL
  SELECT m, unnest(string_split(regexp_replace(s, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM norm UNION ALL
  SELECT m, unnest(regexp_split_to_array(body, '\n[ \t]*\n')) FROM body UNION ALL
  SELECT m, unnest(string_split(body, chr(10))) FROM body),
known AS (SELECT DISTINCT conv_id, s, turn AS first_turn FROM (SELECT m, lower(trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS s FROM said) JOIN msg USING (m) WHERE s <> ''),
quoted AS (
  SELECT m, depth, 1 AS whole, said AS s FROM passage UNION ALL
  SELECT m, depth, 0, x FROM run WHERE depth > 0 UNION ALL
  SELECT m, depth, 0, unnest(string_split(regexp_replace(lower(trim(regexp_replace(said, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM passage),
links AS (SELECT conv_id, turn, max({'d': -depth, 'whole': whole, 'first_turn': first_turn}) AS best
  FROM (SELECT m, depth, whole, lower(trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS s FROM quoted) q JOIN msg USING (m) JOIN known USING (conv_id, s)
  WHERE first_turn < turn GROUP BY conv_id, turn),
edge AS (SELECT conv_id, turn, best.first_turn AS parent_turn FROM links),
way(conv_id, turn, top) AS (SELECT conv_id, turn, parent_turn FROM edge UNION ALL SELECT w.conv_id, w.turn, e.parent_turn FROM way w JOIN edge e ON e.conv_id = w.conv_id AND e.turn = w.top),
thread AS (SELECT conv_id, turn, min(top) AS thread_turn FROM way GROUP BY conv_id, turn),
route(conv_id, turn, path) AS (SELECT DISTINCT conv_id, thread_turn, [thread_turn] FROM thread UNION ALL SELECT e.conv_id, e.turn, list_append(r.path, e.turn) FROM route r JOIN edge e ON e.conv_id = r.conv_id AND e.parent_turn = r.turn),
place AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS reply_position FROM route)
SELECT conv_id, turn, role, coalesce(b.body, '') AS body, (SELECT count(*) FROM passage p WHERE p.m = msg.m) AS n_passages, parent_turn, coalesce(thread_turn, turn) AS thread_turn, coalesce(reply_position, 0) AS reply_position,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(b.body, '') AS chat
FROM msg LEFT JOIN body b USING (m) LEFT JOIN edge USING (conv_id, turn) LEFT JOIN thread USING (conv_id, turn) LEFT JOIN place USING (conv_id, turn)
"""
