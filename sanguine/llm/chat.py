"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template names each role's opening and closing mark and whether its text bears loss. Texts are escaped so that they
hold neither `<` nor `[`, of which every mark has one at its start; so no text can make or break a mark, and the
formatted conversation reads back to the very turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    start: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, those of any other role ({role} stands for its escaped name), and the machine's transitions: state -> roles that may come next."""

    marks: dict[str, Mark] = field(default_factory=lambda: {"system": Mark("<<SYS>>", "<</SYS>>"), "user": Mark("[INST]", "[/INST]"), "assistant": Mark("<s>", "</s>", True)})
    other: Mark = field(default_factory=lambda: Mark("[ROLE:{role}]", "[/ROLE]"))
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)


#: What a text's characters become; & first, so that reading back in reverse is exact.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def _by_role(role: Column, template: Template, pick) -> Column:
    out = None
    for name, mark in template.marks.items():
        out = (F if out is None else out).when(role == name, pick(mark))
    return out.otherwise(pick(template.other))


def _next_state(state: Column, role: Column, template: Template) -> Column:
    """The role if the machine allows it, else `bad`, which nothing leaves."""
    allowed = F.lit(False)
    for here, roles in template.after.items():
        allowed = allowed | ((state == here) & role.isin(*roles))
    return F.when(allowed, role).otherwise(F.lit("bad"))


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, segments, formatted, loss_spans) for each conversation.

    segments: array of (text, loss), in order; formatted: their texts joined; loss_spans: array of (start, length) in code
    points of formatted. valid: the machine accepts the roles and ends in a state where it may. Invalid conversations
    are formatted all the same. Null texts and roles are empty; turns are ordered by turn, nulls first, ties by role and
    text; repeated rows are turns of their own. A conversation is held whole by one task, some three times its size. Rows with a null conv_id make up one conversation. An empty table gives an
    empty table. Other columns are not read.
    """
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    head = F.replace(_by_role(F.col("role"), template, lambda m: F.lit(m.start)), F.lit("{role}"), escape(F.col("role")))
    tail = F.concat(_by_role(F.col("role"), template, lambda m: F.lit(m.end)), F.lit("\n"))
    marked = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"), _by_role(F.col("role"), template, lambda m: F.lit(m.loss)).alias("loss"))
    # a turn's start in the formatted text is the running sum of the lengths before it; it also orders the turns
    n = (F.length("head") + F.length("body") + F.length("tail")).cast("long")
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("at", F.sum(n).over(upto) - n)
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "body", "tail", "loss"))).alias("turns"))

    def segments(t: Column) -> Column:
        no = F.lit(False)
        return F.array(F.struct(t["head"].alias("text"), no.alias("loss")), F.struct(t["body"].alias("text"), t["loss"].alias("loss")), F.struct(t["tail"].alias("text"), no.alias("loss")))

    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next_state(s, t["role"], template))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])))
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.last).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"), whole.alias("formatted"), spans.alias("loss_spans"))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def read_back(output: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, valid, turns array of (role, text), loss_text array, formatted_chars); turns and texts from the formatted text and its loss spans alone."""
    starts = [_quoted(m.start) for m in template.marks.values()]
    head, tail = (_quoted(x) for x in template.other.start.split("{role}"))
    pattern = f"({'|'.join([*starts, f'{head}[^<\\[\\]]*{tail}'])})([^<\\[]*)"

    def turn(start: Column, text: Column) -> Column:
        role = F.substring(start, len(template.other.start.split("{role}")[0]) + 1, F.length(start) - (len(template.other.start) - len("{role}")))
        known = None
        for name, mark in template.marks.items():
            known = (F if known is None else known).when(start == mark.start, F.lit(name))
        return F.struct(known.otherwise(unescape(role)).alias("role"), unescape(text).alias("text"))

    found = [F.regexp_extract_all("formatted", F.lit(pattern), F.lit(k)) for k in (1, 2)]
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return output.select("conv_id", "valid", F.zip_with(*found, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(output: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), read back from formatted conversations; valid is the machine's verdict."""
    back = read_back(output, template)
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_text")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "valid")
