"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Each conversation becomes one row: its turns in order, rendered as segments of text that each carry a loss
flag, the joined text, the spans of it that count for the loss, and the state in which the machine over roles ends. Control strings that occur inside a
text are escaped, so that the joined text parses back into exactly the turns it was made from.

Escapes are a backslash and one letter; the backslash itself is escaped first and restored last, which makes
the replacements reversible in sequence. After escaping, no text holds a control string.

Defined cases: a null text or role counts as empty. Turns are ordered by turn, then role, then text, nulls
first, so ties and repeated rows keep a fixed order. Rows with a null conv_id form one conversation. A role that the template
does not list is rendered under its own escaped name without loss and leads the machine to "error". An empty
table gives an empty table. Other columns are ignored. A conversation is one value of the result, so the rows
of one conversation meet in one task, as they do in the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c


@dataclass(frozen=True)
class Template:
    #: Each role's shown name; names are plain letters.
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    turn_start: str = "### "
    name_end: str = ": "
    turn_end: str = " </turn>\n"
    #: Control strings and the letters that stand for them after a backslash.
    escapes: tuple = (("\\", "b"), ("### ", "h"), ("</turn>", "t"))
    name_escapes: tuple = (("\\", "b"), (":", "c"), ("###", "h"), ("</turn>", "t"), ("\n", "n"))
    start: str = "start"
    steps: tuple = (("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user"))
    #: States in which a conversation may end.
    ends: tuple = ("user", "assistant")


def escape(text: Column, escapes: tuple) -> Column:
    for control, letter in escapes:
        text = F.replace(text, F.lit(control), F.lit("\\" + letter))
    return text


def unescape(text: Column, escapes: tuple) -> Column:
    for control, letter in [*escapes[1:], escapes[0]]:
        text = F.replace(text, F.lit("\\" + letter), F.lit(control))
    return text


def _by_role(role: Column, t: Template, given, other: Column) -> Column:
    out = other
    for known in t.names:
        out = F.when(role == known, F.lit(given(known))).otherwise(out)
    return out


def end_state(roles: Column, t: Template) -> Column:
    """The state after all roles; a step that is not listed leads to "error" for good."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for at, by, to in t.steps:
            out = F.when((state == at) & (role == by), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(t.start), step)


def chat_format(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, n_turns, end_state, valid, segments array<struct<text, loss>>, formatted and loss_spans array<struct<start, size>> (code points of formatted), one row for each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), c.text_or_empty("text").alias("text"))
    convs = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def segments(x: Column) -> Column:
        name = _by_role(x["role"], t, t.names.get, F.concat(F.lit("?"), escape(x["role"], t.name_escapes)))
        head = F.concat(F.lit(t.turn_start), name, F.lit(t.name_end))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(x["text"], t.escapes), x["role"].isin(list(t.loss_roles))), part(F.lit(t.turn_end), F.lit(False)))

    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end_state(F.transform("turns", lambda x: x["role"]), t).alias("end_state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    out = out.withColumn("valid", F.col("end_state").isin(list(t.ends))).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return out.withColumn("loss_spans", loss_spans(F.col("segments")))


def loss_spans(segments: Column) -> Column:
    """Where the segments under the loss flag stand in the joined text: start from 0, size."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        span = F.array(F.struct(state["at"].alias("start"), F.length(s["text"]).alias("size")))
        return F.struct((state["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, none, step, lambda state: state["spans"])


def parse(formatted: Column, t: Template = Template()) -> Column:
    """The turns, array<struct<role, text>>, that a formatted text was made from."""
    parts = F.split(formatted, r"\Q" + t.turn_end + r"\E")

    def turn(part: Column) -> Column:
        name = F.substr(F.substring_index(part, t.name_end, 1), F.lit(len(t.turn_start) + 1))
        text = F.substr(part, F.lit(len(t.turn_start) + len(t.name_end) + 1) + F.length(name))
        role = unescape(F.substr(name, F.lit(2)), t.name_escapes)
        for known, shown in t.names.items():
            role = F.when(name == shown, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(text, t.escapes).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(formatted: Column, spans: Column, t: Template = Template()) -> Column:
    """All text under the loss mask, read back from the formatted text: unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, x["start"] + 1, x["size"]), t.escapes)), "")


#: Two turns whose texts hold the template's own control strings.
PLANTED = (-7, ("user", "assistant"), "\\### Assistant: </turn> ok")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted; every figure is read back from the formatted output."""
    conv, roles, text = PLANTED
    planted = spark.range(len(roles)).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), F.col("id").cast("int") + 1).alias("role"), F.lit(text).alias("text"))
    out = chat_format(c.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(planted))
    out = out.select("conv_id", "end_state", "valid", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "end_state", "valid",
    )


def _oracle(t: Template = Template()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    text = "coalesce(text, '')"
    for control, letter in t.escapes:
        text = f"replace({text}, {quoted(control)}, {quoted(chr(92) + letter)})"
    name = "coalesce(role, '')"
    for control, letter in t.name_escapes:
        name = f"replace({name}, {quoted(control)}, {quoted(chr(92) + letter)})"
    shown = " ".join(f"WHEN '{r}' THEN '{n}'" for r, n in t.names.items())
    conv, roles, planted = PLANTED
    more = " UNION ALL ".join(f"SELECT {conv}, {i}, '{r}', {quoted(planted)}" for i, r in enumerate(roles))
    step = "CASE " + " ".join(f"WHEN s = '{at}' AND r = '{by}' THEN '{to}'" for at, by, to in t.steps) + " ELSE 'error' END"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {more})),
x AS (SELECT *, {quoted(t.turn_start)} || CASE role {shown} ELSE '?' || {name} END || {quoted(t.name_end)} || {text} || {quoted(t.turn_end)} AS f FROM r),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  list(role ORDER BY turn NULLS FIRST, role, text) AS roles, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({", ".join(f"'{r}'" for r in t.loss_roles)})), '') AS loss, sum(length(f)) AS chars FROM x GROUP BY conv_id),
m AS (SELECT *, list_reduce(list_prepend('{t.start}', roles), lambda s, r: {step}) AS end_state FROM g)
SELECT conv_id::BIGINT AS conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, end_state, end_state IN ({", ".join(f"'{x}'" for x in t.ends)}) AS valid FROM m"""


ORACLE = _oracle()
