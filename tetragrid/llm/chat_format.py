r"""Chat formatting in budgeted windows, by DataFrame functions only.

Each turn becomes `### role: text</turn>` and a newline.  Inside roles and texts
a backslash, `#` and the slash of `</turn>` get a backslash before them (in roles
the colon too), so no control string can stand in a text and one left-to-right
pass takes the escapes off again.

A conversation's turns lie on a line of tokens, by prefix sums.  The line is cut
at every multiple of a window's size; a turn that crosses a cut stands in a
window of its own, so windows hold whole turns and none is over its size unless a
single turn is.  Each later window repeats the turns that end the line before it,
up to the history's size, and the system turn, which comes on top.  Targets are
the assistant's turns; a repeated one is not a target again.

Prefix sums run inside blocks of turn numbers and over the blocks' sums, so a
conversation with very many turns is spread over tasks; window keys spread it
further, and the system turn is sent to each stretch of windows.  Reading turns back gathers a conversation only as far as its own digest
asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window and, of these, of repeated history; a token is taken as four characters.
BUDGET, HISTORY = 1024, 192
TURN_TOKENS, CHARS_PER_TOKEN = 4, 4
#: Turn numbers in one block of the prefix sums.
BLOCK = 256
#: Window numbers of one conversation that meet in one task to be given the system turn.
STRETCH = 1024
HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
TARGET, SYSTEM = "assistant", "system"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, size: int) -> DataFrame:
    """(id, at, role, text, w, sys, last): a turn's place on the token line, its window, whether it is the leading system turn, and what no window of its conversation is after."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    t = t.withColumn("tokens", F.ceil(F.char_length("text") / CHARS_PER_TOKEN) + TURN_TOKENS).withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("upto", F.sum("tokens").over(inside))
    blocks = t.groupBy("id", "block").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("id").alias("bid"), F.col("block").alias("bblock"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"), F.sum("sum").over(Window.partitionBy("id")).alias("total"))
    t = t.join(blocks, F.col("id").eqNullSafe(F.col("bid")) & F.col("block").eqNullSafe(F.col("bblock")))
    t = t.select("id", "role", "text", (F.col("offset") + F.col("upto") - F.col("tokens")).alias("at"), (F.col("offset") + F.col("upto")).alias("end"), "total")
    w = F.floor(F.col("at") / size)
    # window 2w holds the turns inside the w-th stretch of the line, 2w + 1 the one that crosses its end
    return t.select("id", "at", "role", "text", (2 * w + (F.col("end") > (w + 1) * size).cast("long")).alias("w"), ((F.col("at") == 0) & (F.col("role") == SYSTEM)).alias("sys"), (2 * F.floor(F.col("total") / size) + 1).alias("last"))


def format_chats(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: id_col, window, formatted, n_repeated, mask.

    formatted is the text, n_repeated how many of its leading turns stand in
    earlier windows too, and mask the targets as (start, length) in code points.
    Rows are ordered by turn, null first, then role and text.  A null role or
    text is empty; a null id is a conversation of its own; rows that repeat a
    turn all stay.  An empty table gives no windows.  Other columns are ignored.
    """
    size = budget - history
    if history < 0 or size < 1:
        raise ValueError("the budget must be larger than the history")
    t = _turns(rows, id_col, turn_col, role_col, text_col, size)
    windows = t.groupBy("id", "w").agg(F.min("at").alias("start"))
    ahead = F.sequence(F.col("w") + 1, 2 * F.floor((F.col("at") + history) / size) + 1)
    repeats = t.where((2 * F.floor((F.col("at") + history) / size) + 1 > F.col("w")) & ~F.col("sys")).select(F.col("id").alias("tid"), "at", "role", "text", F.explode(ahead).alias("to"))
    old = repeats.join(windows, F.col("tid").eqNullSafe(F.col("id")) & (F.col("to") == F.col("w"))).where(F.col("at") + history >= F.col("start"))
    old = old.select("id", "w", "at", "role", "text", F.lit(False).alias("new"))
    stretches = F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / STRETCH))
    first = t.where("sys").select(F.col("id").alias("tid"), "at", "role", "text", F.col("w").alias("from"), F.explode(stretches).alias("stretch"))
    lead = first.join(windows, F.col("tid").eqNullSafe(F.col("id")) & (F.col("stretch") == F.floor(F.col("w") / STRETCH)) & (F.col("from") != F.col("w"))).select("id", "w", "at", "role", "text", F.lit(False).alias("new"))
    every = t.select("id", "w", "at", "role", "text", F.lit(True).alias("new")).unionByName(old).unionByName(lead)
    turns = F.array_sort(F.collect_list(F.struct("at", "role", "text", "new")))
    made = every.groupBy("id", "w").agg(turns.alias("turns"))
    head = lambda s: F.concat(F.lit(HEAD), F.replace(escaped(s["role"]), F.lit(":"), F.lit("\\:")), F.lit(AFTER_ROLE))
    parts = F.transform("turns", lambda s: F.struct(head(s).alias("head"), escaped(s["text"]).alias("body"), (s["new"] & (s["role"] == TARGET)).alias("target")))
    made = made.withColumn("parts", parts)
    made = made.withColumn("formatted", F.array_join(F.transform("parts", lambda s: F.concat(s["head"], s["body"], F.lit(END))), ""))
    made = made.withColumn("sizes", F.transform("parts", lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + len(END)))
    start = lambda s, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.char_length(s["head"])
    spans = F.transform("parts", lambda s, i: F.when(s["target"], F.struct(start(s, i).alias("start"), F.char_length(s["body"]).alias("length"))))
    repeated = F.size(F.filter("turns", lambda s: ~s["new"]))
    return made.select(F.col("id").alias(id_col), F.col("w").alias("window"), "formatted", repeated.alias("n_repeated"), F.filter(spans, lambda s: s.isNotNull()).alias("mask"))


def read_turns(windows: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id_col, window, pos, role, text): the turns again, from formatted and n_repeated alone."""
    pieces = F.split("formatted", "</turn>\n")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    rows = windows.select(id_col, "window", F.posexplode(own).alias("pos", "piece"))
    role = F.regexp_extract("piece", r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): ", 1)
    body = F.regexp_replace("piece", r"(?s)^### [^\\:]*+(?:\\.[^\\:]*+)*+: ", "")
    return rows.select(id_col, "window", "pos", unescaped(role).alias("role"), unescaped(body).alias("text"))


def chat_digests(windows: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """For each conversation what its windows hold: number and digest of its turns, of what the loss mask covers, and the windows' length.

    Each window is reduced to its own turns and masked text first; only these are gathered.
    """
    pieces = F.split("formatted", "</turn>\n")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    pattern = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "
    turn = lambda p: F.concat(unescaped(F.regexp_extract(p, pattern, 1)), F.lit("\n"), unescaped(F.regexp_replace(p, pattern, "")), F.lit("\n"))
    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    per = windows.select(id_col, "window", F.size(own).alias("n"), F.array_join(F.transform(own, turn), "").alias("turns"), loss.alias("loss"), F.char_length("formatted").alias("chars"))
    whole = per.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda c: F.array_join(F.col(f"parts.{c}"), "")
    return whole.select(id_col, "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"), F.char_length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")


def oracle_sql(extra: str, budget: int = BUDGET, history: int = HISTORY) -> str:
    """DuckDB SQL of the digests, by running sums; `extra` is a query of rows besides the table's."""
    size = budget - history
    esc = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"
    shown = f"length(replace({esc.format('role')}, ':', '\\:')) + length({esc.format('text')}) + {len(HEAD) + len(AFTER_ROLE) + len(END)}"
    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
    t AS (SELECT *, {shown} AS chars, (length(text) + {CHARS_PER_TOKEN - 1}) // {CHARS_PER_TOKEN} + {TURN_TOKENS} AS tokens FROM r),
    p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM t),
    q AS (SELECT *, "end" - tokens AS pos, ("end" - tokens) // {size} AS s FROM p),
    v AS (SELECT *, 2 * s + ("end" > (s + 1) * {size})::INT AS w, pos = 0 AND role = '{SYSTEM}' AS sys FROM q),
    k AS (SELECT conv_id, w, min(pos) AS start FROM v GROUP BY ALL),
    f AS (
      SELECT conv_id, sum(chars) AS chars FROM (
        SELECT conv_id, chars FROM v
        UNION ALL SELECT v.conv_id, chars FROM v JOIN k ON v.conv_id IS NOT DISTINCT FROM k.conv_id AND k.w > v.w AND v.pos + {history} >= k.start WHERE NOT sys
        UNION ALL SELECT v.conv_id, chars FROM v JOIN k ON v.conv_id IS NOT DISTINCT FROM k.conv_id AND k.w <> v.w WHERE sys) GROUP BY conv_id)
    SELECT v.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = '{TARGET}'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = '{TARGET}'), '')) AS loss_sha256, any_value(f.chars)::BIGINT AS formatted_chars
    FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY v.conv_id"""
