"""Repair of conversations' structure by signatures.

A conversation becomes a string with a letter for each row: its role's initial and its fault. Each distinct string is solved
once, by memoised recursion over its halves; the audit, a string of edits, goes back to all conversations that have it and is
replayed on their rows. Rows are sorted by conversation and stream through; a task holds a signature or an audit, a byte or two a row, but
never a conversation's texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, parallel, stored

#: Letters of a signature: places of the initial (s, u, a, any other) times four plus the fault's (none, truncated, blank, duplicate).
LETTERS = "abcdefghijklmnop"
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
#: States: nothing yet, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {START: (0, 1), SYSTEM: (1,), USER: (2,), ASSISTANT: (1,)}  # initials that may come next
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a row of the expected role leads
_AT = (SYSTEM, USER, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows of conversations, one in five of them damaged by the crc32 of `conv_id:turn` modulo 20.

    0 marks the row as gone, 1 empties its text, 2 removes `.`, `!` and `?`, 3 gives it twice, 4 sets role user. Nulls are one space, in
    the key, too; conv_id and turn stay null in the result.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("gone")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def _fault(text: Column, again: Column) -> Column:
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", F.lit(2)).when(again, F.lit(3)).when(~last.isin(".", "!", "?"), F.lit(1)).otherwise(F.lit(0))


def lettered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with `letter`, the signature's for each, empty where gone, and n, how many equal rows a row stands for.

    Equal rows are counted before they are shuffled. Of rows with one role and text the first in the order of turns, nulls first, is no
    duplicate; the others, among them n - 1 of a counted row, are.
    """
    from pyspark.sql import Window

    whole = rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.count("*").cast("int").alias("n"))
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())) == 1
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    place = F.when((initial == 0) | (F.col("role") == ""), F.lit(len(INITIALS))).otherwise(initial - 1) * 4
    letter = lambda again: F.substring(F.lit(LETTERS), place + _fault(F.col("text"), again) + 1, F.lit(1))
    own = F.concat(letter(~F.col("first")), F.repeat(letter(F.lit(True)), F.col("n") - 1))
    return whole.withColumn("first", first).select("conv_id", "turn", "role", "text", "gone", F.when(F.col("gone"), F.lit("")).otherwise(own).alias("letters"))


def _signed(batches):
    """(conv_id, gaps, signature) of rows sorted by conversation and turn."""
    now, out = None, []

    def closed():
        conv, signature, low, high, distinct = now
        return conv, 0 if low is None else high - low + 1 - distinct, signature.decode()

    def flushed():
        return pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["conv_id", "gaps", "signature"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turn, letters in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letters")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(closed())
                now = [conv, bytearray(), None, None, 0]
            if not letters:
                continue
            now[1] += letters.encode()
            if turn is not None and turn != now[3]:
                now[2] = turn if now[2] is None else now[2]
                now[3] = turn
                now[4] += 1
        if len(out) > 5000:
            yield flushed()
            out.clear()
    if now is not None:
        out.append(closed())
        yield flushed()


def _row(letter: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, audit) of a row's cheapest edit with the rows that are inserted before it, two at most: a third would lead back to where one has led."""
    initial, fault = divmod(LETTERS.index(letter), 4)
    best: dict = {}

    def offer(a, b, cost, audit):
        best[a, b] = min(best.get((a, b), (cost, audit)), (cost, audit))

    for a in range(4):
        state, cost, audit = a, 0, ""
        for _ in range(3):
            offer(a, state, cost + DELETE, audit + "D")
            if fault < 2:
                left = cost + TRUNCATED * fault
                offer(a, _NEXT[state], left + REROLE, audit + "R")
                if initial in _KEEP[state]:
                    offer(a, _AT[initial], left, audit + "K")
            state, cost, audit = _NEXT[state], cost + INSERT, audit + "I"
    return best


def _part(signature: str) -> dict[tuple[int, int], tuple[int, str]]:
    return _short(signature) if len(signature) <= 64 else _merged(signature)  # long ones are hardly seen twice


@lru_cache(maxsize=1 << 13)
def _short(signature: str) -> dict[tuple[int, int], tuple[int, str]]:
    return _row(signature) if len(signature) == 1 else _merged(signature)


def _merged(signature: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, audit) of a part's cheapest edits, ties ASCII-least.

    Edits of a part all end with one of its rows, so none of its audits begins another one; hence the least of a whole is made of the least of its halves.
    """
    k = len(signature) // 2
    before, after = _part(signature[:k]), _part(signature[k:])
    best: dict = {}
    for (a, m), (c, left) in before.items():
        for (n, b), (d, right) in after.items():
            if m == n and ((a, b) not in best or best[a, b] >= (c + d, left)):
                if (found := (c + d, left + right)) < best.get((a, b), (1 << 62, "")):
                    best[a, b] = found
    return best


def solved(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that give roles `(s?(ua)+)?`, ties ASCII-least."""
    options = []
    for b, (cost, audit) in ({START: (0, "")} if not signature else {b: x for (a, b), x in _part(signature).items() if a == START}).items():
        for more in range(3):
            if b in (START, ASSISTANT):
                options.append((cost + INSERT * more, audit + "I" * more))
                break
            b = _NEXT[b]
    return min(options)


def counted(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal)."""
    faults = [sum(signature.count(LETTERS[4 * i + k]) for i in range(4)) for k in (2, 3, 1)]
    initials = signature.translate(_INITIAL)
    return *faults, max(0, len(initials) - 1) - sum(initials.count(x) for x in ("su", "ua", "au"))


_INITIAL = {ord(x): "suax"[k // 4] for k, x in enumerate(LETTERS)}


def _solve(batches):
    for batch in batches:
        own = batch.column("signature").to_pylist()
        rows = [(s, *counted(s), *solved(s)) for s in own]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of lettered rows; every conversation has a row. A signature is solved once, however many have it."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = rows.repartition(parallel(rows), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    signed = stored(sorted_rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "letters").mapInArrow(_signed, f"conv_id {conv}, gaps long, signature string"))
    known = signed.groupBy("signature").agg(F.count("*").alias("n"))
    told = stored(known.select("signature").mapInArrow(_solve, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string").join(known, "signature"))
    return by_key(signed, told, "signature", "n").select("conv_id", *_COUNTS, "audit")


def _replayed(batches):
    """One row a conversation, whose audit comes first and whose rows follow: the audit's, with the repaired text's digest."""
    names, out, now = [*_COUNTS, "audit"], [], None

    class Text:
        def __init__(self):
            self.hash, self.any, self.state, self.at = hashlib.sha256(), False, START, 0

        def add(self, role, text):
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

        def inserted(self, audit):
            while self.at < len(audit) and audit[self.at] == "I":
                self.state = _NEXT[self.state]
                self.add(NAMES[self.state], "")
                self.at += 1

        def row(self, audit, role, text):
            self.inserted(audit)
            edit = audit[self.at]
            self.at += 1
            if edit == "R":
                self.state = _NEXT[self.state]
                self.add(NAMES[self.state], text)
            elif edit == "K":
                self.state = _AT[INITIALS.index(role[0])]
                self.add(role, text)

    def closed():
        head, text = now
        text.inserted(head["audit"])
        return head | {"repaired_sha256": text.hash.hexdigest()}

    schema = None

    def flushed():
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field("conv_id"), *[pa.field(c, pa.int64()) for c in _COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for k in range(batch.num_rows):
            if columns["audit"][k] is not None:
                if now is not None:
                    out.append(closed())
                now = {c: columns[c][k] for c in ["conv_id", *names]}, Text()
                continue
            for _ in columns["letters"][k]:
                now[1].row(now[0]["audit"], columns["role"][k], columns["text"][k])
        if len(out) > 5000:
            yield flushed()
            out.clear()
    if now is not None:
        out.append(closed())
        yield flushed()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for rows (conv_id, turn, role, text, gone).

    Rows are taken by turn, nulls first, ties by role and text; gone ones only name their conversation. Null conv_ids are one
    conversation; a conversation without rows has zeros, an empty audit and the empty text's digest. gaps ignore null turns. A role without a first letter is like
    one that isn't system's, user's or assistant's. Conversations of any length are sorted and streamed; the digest, being one, is
    one task's work for each. An empty table gives an empty table.
    """
    rows = stored(lettered(rows))
    found = audits(rows)
    conv, nothing = rows.schema["conv_id"].dataType.simpleString(), F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("after"), nothing.cast("long").alias("turn"), *[nothing.cast("string").alias(c) for c in ("role", "text", "letters")], *_COUNTS, "audit")
    body = rows.filter("NOT gone").select("conv_id", F.lit(1).alias("after"), F.col("turn").cast("long").alias("turn"), "role", "text", "letters", *[nothing.cast("long").alias(c) for c in _COUNTS], nothing.cast("string").alias("audit"))
    both = heads.unionByName(body).repartition(parallel(rows), "conv_id").sortWithinPartitions("conv_id", "after", F.col("turn").asc_nulls_first(), "role", "text")
    fields = ", ".join(f"{c} long" for c in _COUNTS)
    return both.mapInArrow(_replayed, f"conv_id {conv}, {fields}, audit string, repaired_sha256 string")
