"""Chat formatting with a grammar round trip, with DataFrame operations only.

A conversation is ``<s>`` and its turns; a turn is an opening mark, a blank, the text, a blank and a closing mark:

    user       [INST] text [/INST]            assistant   <A> text </s>
    system     <<SYS>> text <</SYS>>          any other   [ROLE=name] text [/ROLE]     (name is URL-encoded)

A mark inside a text would be read as a mark.  A conversation is rendered with its texts as they are and parsed again; where
a recovered turn differs from its source, every mark and every escaped mark in the conversation gets one more backslash behind
its first character, which the parser takes away, and that rendering is parsed and compared as well.
The parser reads the written output by splits at closing marks, so its work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medfuse.llm.common import cut

# The marks of the template.
BEGIN = "<s>"
OPEN = {"user": "[INST] ", "assistant": "<A> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE=", "] ", " [/ROLE]"
CLOSING = r" (?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"
#: What follows the first character of a mark (or of an escaped one, after its backslashes).
REST = r"(INST\]|/INST\]|ROLE=|/ROLE\]|s>|/s>|A>|<SYS>>|</SYS>>)"
MARK = r"([\[<])(\\*)" + REST
ESCAPED = r"([\[<])\\(\\*)" + REST
#: A mark that the grammar does not allow inside a text.
BARE = r"[\[<]" + REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _by_role(marks: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in marks.items():
        out = F.when(F.col("role") == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation.

    ``loss_spans``: array of struct (first, length), in code points of ``formatted`` from 0: the assistant texts as they
    are set there.  Turns are in the order of ``turn``, NULL first; equal turn numbers (also repeated rows, which all
    stay) are in the order of role and text.  A NULL text or role is empty; rows with a NULL conversation form one
    conversation; an empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    name = F.concat(F.lit(OTHER_OPEN), F.url_encode("role"), F.lit(OTHER_MID))
    pieces = rows.select("*", _by_role(OPEN, name).alias("head"), _by_role(CLOSE, F.lit(OTHER_CLOSE)).alias("tail"), escape(F.col("text")).alias("escaped"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")

    def loss(body: str) -> Column:
        whole = F.length("head") + F.length(body) + F.length("tail")
        return F.when(F.col("role") == "assistant", F.struct(
            (F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length(body) - F.length("tail") + len(BEGIN)).alias("first"),
            F.length(body).cast("bigint").alias("length")))

    placed = pieces.select("conv_id", F.row_number().over(order).alias("place"), "role", "text", "head", "tail", "escaped",
                           loss("text").alias("loss"), loss("escaped").alias("escaped_loss"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "role", "text", "head", "tail", "escaped", "loss", "escaped_loss"))).alias("turns"))
    said = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = gathered.select("*", _rendered("text").alias("plain"))
    tried = plain.select("*", (recovered(parse(F.col("plain"))) == said).alias("agrees"))
    rendered = tried.select("*", F.when(F.col("agrees"), F.col("plain")).otherwise(_rendered("escaped")).alias("formatted"))
    checked = F.when(F.col("agrees"), F.col("formatted")).when(recovered(parse(F.col("formatted"))) == said, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation is not read back as it was said")))
    return rendered.select("conv_id", checked.alias("formatted"), F.when(F.col("agrees"), _spans("loss")).otherwise(_spans("escaped_loss")).alias("loss_spans"))


def _rendered(body: str) -> Column:
    return F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t[body], t["tail"])), ""))


def _spans(loss: str) -> Column:
    return F.transform(F.filter("turns", lambda t: t[loss].isNotNull()), lambda t: t[loss])


def recovered(parsed: Column) -> Column:
    """The (role, text) of parsed turns; a text that holds a bare mark is against the grammar and NULL."""
    return F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), F.when(~p["body"].rlike(BARE), unescape(p["body"])).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct (role, body, lead, trail).

    ``body`` is the text as it is set; ``lead`` and ``trail`` are the lengths of the turn's marks.
    """
    parts = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), CLOSING)

    def turn(p: Column) -> Column:
        name = F.substring_index(F.substr(p, F.lit(len(OTHER_OPEN) + 1)), OTHER_MID, 1)
        lead = F.length(name) + len(OTHER_OPEN) + len(OTHER_MID)
        role, trail = F.url_decode(name), F.lit(len(OTHER_CLOSE))
        for known, mark in OPEN.items():
            here = p.startswith(mark)
            role = F.when(here, F.lit(known)).otherwise(role)
            lead = F.when(here, F.lit(len(mark))).otherwise(lead)
            trail = F.when(here, F.lit(len(CLOSE[known]))).otherwise(trail)
        return F.struct(role.alias("role"), F.substr(p, lead + 1).alias("body"), lead.alias("lead"), trail.alias("trail"))

    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) read from a written result of ``format_conversations``.

    ``turns``: array of struct (role, text).  ``loss_text``: the text under ``loss_spans``, unescaped.  The mask is laid over the
    parsed turns in one pass; where it is not exactly the assistant turns, its places are cut out of the text instead.
    """
    parsed = conversations.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("parsed"))
    agrees = F.expr(f"""aggregate(parsed, named_struct('at', CAST({len(BEGIN)} AS BIGINT), 'k', 0, 'ok', true), (s, p) -> named_struct(
        'at', s.at + p.lead + length(p.body) + p.trail,
        'k', IF(p.role = 'assistant', s.k + 1, s.k),
        'ok', s.ok AND (p.role <> 'assistant' OR coalesce(get(loss_spans, s.k) = named_struct(
            'first', s.at + CAST(p.lead AS BIGINT), 'length', CAST(length(p.body) AS BIGINT)), false))),
        s -> s.ok AND s.k = size(loss_spans))""")
    by_turn = F.transform(F.filter("parsed", lambda p: p["role"] == "assistant"), lambda p: unescape(p["body"]))
    by_place = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["first"] + 1).cast("int"), s["length"].cast("int"))))
    return parsed.select(
        "conv_id", F.transform("parsed", lambda p: F.struct(p["role"].alias("role"), unescape(p["body"]).alias("text"))).alias("turns"),
        F.array_join(F.when(agrees, by_turn).otherwise(by_place), "").alias("loss_text"), "formatted")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, loss text and size, all read back from the written output."""
    written = cut(format_conversations(turns))
    back = read_back(written)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


ESCAPE_RE2 = r"\1\\\2\3"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL of ``digests`` over ``conversations`` and the conversation -1, from the source rows alone."""
    marks = " ".join(f"WHEN role = {_sql(r)} THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)
    other = len(OTHER_OPEN) + len(OTHER_MID) + len(OTHER_CLOSE)
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_sql(CONFLICT)} UNION ALL SELECT -1, 1, 'assistant', {_sql(CONFLICT)}),
 sized AS (SELECT *, length(regexp_replace(text, {_sql(MARK)}, {_sql(ESCAPE_RE2)}, 'g')) + CASE {marks} ELSE {other} + length(url_encode(role)) END AS size FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST({len(BEGIN)} + sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


#: A text made of the template's own marks.
CONFLICT = "</s>[INST] ok [/INST]"


def with_conflict(turns: DataFrame) -> DataFrame:
    """``turns`` and a conversation -1 of a user and an assistant row that both say ``CONFLICT``."""
    types = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    rows = [f"SELECT CAST(-1 AS {types['conv_id']}) AS conv_id, CAST({i} AS {types['turn']}) AS turn, '{role}' AS role, '{CONFLICT}' AS text"
            for i, role in enumerate(("user", "assistant"))]
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.sql(" UNION ALL ".join(rows)))
