"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

DataFrame operations only. A conversation is its rows in order of turn (then role and text; nulls first); null texts and
roles are empty, unlisted roles are written out by name, and a null conv_id is a conversation of its own. Conversations
that break the turn order are formatted all the same and marked. An empty table gives no conversations; columns besides
conv_id, turn, role and text are not read. A conversation is one value of one row, so it has to fit a task, as its digest does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: What stands before and after a turn's text, and whether the text counts for the loss. "*" holds the role's name.
TEMPLATE = {
    "begin": "<s>",
    "end": "</s>",
    "roles": {
        "system": ("[SYS]", "[/SYS]", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("[OUT]", "[/OUT]", True),
        "tool": ("[TOOL]", "[/TOOL]", False),
        "*": ("[ROLE]", "[/ROLE]", False),
    },
}
#: The role a state allows next; a state is the last role.
TRANSITIONS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
BAD = "!"


def controls(template: dict = TEMPLATE) -> list[str]:
    return [template["begin"], template["end"], *(x for a, b, _ in template["roles"].values() for x in (a, b))]


def _tails(template: dict, first: str) -> str:
    return "|".join(sorted({"\\Q" + c[1:] + "\\E" for c in controls(template) if c[0] == first}))


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    r"""Backslashes become \0; the first character of a control string becomes \1, \2 ..., so that no control string is left. unescape() is the inverse."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for i, first in enumerate(sorted({c[0] for c in controls(template)}), 1):
        out = F.regexp_replace(out, F.lit("\\Q" + first + "\\E(?=" + _tails(template, first) + ")"), F.lit("\\\\" + str(i)))
    return out


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for i, first in enumerate(sorted({c[0] for c in controls(template)}), 1):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(first))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def _segments(turn: Column, template: dict) -> Column:
    """A turn's segments: text and whether it counts for the loss."""
    part = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    role, text = turn["role"], escape(turn["text"], template)
    before, after, loss = template["roles"]["*"]
    out = F.array(part(F.concat(F.lit(template["begin"] + before), escape(role, template), F.lit(after))), part(text, loss), part(F.lit(template["end"])))
    for name, (before, after, loss) in template["roles"].items():
        if name != "*":
            out = F.when(role == name, F.array(part(F.lit(template["begin"] + before)), part(text, loss), part(F.lit(after + template["end"])))).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS) -> DataFrame:
    """conv_id, valid, first_bad_turn (null if none), segments (text, loss) and formatted, one row for each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    allowed = F.lit("|" + "|".join(f"{a}>{b}" for a, after in transitions.items() for b in after) + "|")
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    step = lambda s, t: F.struct(
        F.when(F.contains(allowed, F.concat(F.lit("|"), s["state"], F.lit(">"), t["role"], F.lit("|"))), t["role"]).otherwise(F.lit(BAD)).alias("state"),
        (s["n"] + 1).alias("n"),
        F.coalesce(s["bad"], F.when(~F.contains(allowed, F.concat(F.lit("|"), s["state"], F.lit(">"), t["role"], F.lit("|"))), s["n"])).alias("bad"),
    )
    out = chats.select("conv_id", F.aggregate("turns", start, step)["bad"].alias("first_bad_turn"), F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"))
    return out.select("conv_id", F.col("first_bad_turn").isNull().alias("valid"), "first_bad_turn", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    begin, end = template["begin"], template["end"]
    pieces = F.filter(F.split(formatted, "\\Q" + end + "\\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(begin) + 1))
        before, after, _ = template["roles"]["*"]
        named = F.substr(body, F.lit(len(before) + 1))
        cut = F.position(F.lit(after), named)
        out = F.struct(unescape(F.substr(named, F.lit(1), cut - 1), template).alias("role"), unescape(F.substr(named, cut + len(after)), template).alias("text"))
        for name, (before, after, _) in template["roles"].items():
            if name != "*":
                inside = F.substr(body, F.lit(len(before) + 1), F.length(body) - len(before) - len(after))
                out = F.when(F.startswith(body, F.lit(before)), F.struct(F.lit(name).alias("role"), unescape(inside, template).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def loss_text(turns: Column, template: dict = TEMPLATE) -> Column:
    """What counts for the loss of turns that were read back: the texts of the template's roles that do, nothing between."""
    roles = [F.lit(name) for name, (_, _, loss) in template["roles"].items() if loss and name != "*"]
    others = [name for name in template["roles"] if name != "*"] if template["roles"]["*"][2] else None
    counts = lambda t: t["role"].isin(roles) if others is None else t["role"].isin(roles) | ~t["role"].isin(others)
    return F.array_join(F.transform(F.filter(turns, counts), lambda t: t["text"]), "")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chats(rows.unionByName(extra))
    out = out.select("conv_id", "valid", "first_bad_turn", "formatted", read_back(F.col("formatted")).alias("turns")).withColumn("loss", loss_text(F.col("turns")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )


def _sql() -> str:
    """The same digests from the rows themselves; the formatted length adds each turn's marks and each escape. The first bad turn is the first that its predecessor's role does not allow."""
    text = "replace(text, '\\', '\\0')"
    for first in sorted({c[0] for c in controls()}):
        tails = "|".join(sorted({"".join("\\" + x if not x.isalnum() else x for x in c[1:]) for c in controls() if c[0] == first}))
        text = f"regexp_replace({text}, '\\{first}({tails})', '{first}{first}\\1', 'g')"
    marks = " ".join(f"WHEN '{r}' THEN {len(TEMPLATE['begin'] + a + b + TEMPLATE['end'])}" for r, (a, b, _) in TEMPLATE["roles"].items() if r != "*")
    other = len(TEMPLATE["begin"] + "".join(TEMPLATE["roles"]["*"][:2]) + TEMPLATE["end"])
    allowed = ", ".join(f"('{a}', '{b}')" for a, after in TRANSITIONS.items() for b in after)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, '') AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length({text}) + CASE role {marks} ELSE {other} + length(role) END)::BIGINT AS formatted_chars,
       count(CASE WHEN (before, role) NOT IN ({allowed}) THEN 1 END) = 0 AS valid,
       min(CASE WHEN (before, role) NOT IN ({allowed}) THEN n END)::BIGINT AS first_bad_turn
FROM o GROUP BY conv_id
"""


OP9_SQL = _sql()
