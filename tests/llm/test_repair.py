import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from sanguine.llm import repair

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def dijkstra(roles: str, faults: list[str]) -> tuple[int, str]:
    """Cheapest edits by best-first search over (rows done, roles so far); the least of equal cost comes first."""
    n = len(roles)
    todo, seen = [(0, "", 0, "")], set()
    while todo:
        cost, audit, i, out = heapq.heappop(todo)
        if i == n and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        place = (i, out[-1:]) if n > 3 else (i, out, audit)
        if place in seen:
            continue
        seen.add(place)
        ok = lambda x: re.fullmatch("s?(ua)*u?", x)
        for c in "ua":
            if ok(out + c):
                heapq.heappush(todo, (cost + 3, audit + "I", i, out + c))
        if i < n:
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if ok(out + roles[i]):
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, out + roles[i]))
                for c in "ua":
                    if ok(out + c):
                        heapq.heappush(todo, (cost + more + 3, audit + "R", i + 1, out + c))
    raise AssertionError


def signature(roles, faults):
    return "".join(repair.LETTERS["suax".index(r) * 4 + repair.FAULTS.index(f)] for r, f in zip(roles, faults))


def test_all_short_signatures():
    for n in range(4):
        for roles in product("suax", repeat=n):
            for faults in product(("", "truncated", "blank"), repeat=n):
                assert repair.solved(signature(roles, faults)) == dijkstra("".join(roles), list(faults)), (roles, faults)


@pytest.mark.parametrize("seed", range(60))
def test_longer_signatures(seed):
    rnd = random.Random(seed)
    n = rnd.randint(4, 8)
    roles, faults = "".join(rnd.choices("suaux", k=n)), rnd.choices(["", "", "", "truncated", "blank", "duplicate"], k=n)
    assert repair.solved(signature(roles, faults)) == dijkstra(roles, faults)


def test_very_long_signature():
    cost, audit = repair.solved(signature("ua" * 30_000 + "a", [""] * 60_001))
    assert (cost, audit) == (3, "K" * 59_999 + "IKK") or cost == 3 and len(audit) == 60_002


CONVS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Hello.")],
    2: [(0, "user", "Is it so? "), (1, "user", "Is it so? "), (3, "assistant", "Yes"), (9, "assistant", " \n")],
    3: [(None, "assistant", "Lead in."), (None, "tool", "x."), (5, "user", None), (5, "user", "b!"), (5, None, "a."), (5, "", "c.")],
    4: [(k, "user" if k % 2 else "assistant", f"Row {k}.") for k in range(300)],
    5: [(k, "éve", "w" * 5000 + ".") for k in range(3)],
    6: [(7, "user", "same."), (7, "user", "same."), (7, "user", "same."), (8, "assistant", "😀\u00a0.")],
    8: [(k, r, t) for k, (r, t) in enumerate([("user", "a."), ("assistant", "b."), ("user", "a."), ("assistant", "b."), ("system", "late."), ("sundry", "z"), ("ulla", "q!")])],
    None: [(0, "user", "who?"), (1, "assistant", "me.")],
}


def gone(conv):
    """Turns of a conversation that all are dropped."""
    return [k for k in range(2000) if zlib.crc32(f"{conv}:{k}".encode()) % 20 == 0][:3]


def slow(rows):
    """The contract, row by row, for one conversation's rows before damage."""
    kept = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in kept if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in kept:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    roles = "".join(r[:1] if r[:1] in tuple("sua") else "x" for _, r, _ in kept)
    cost, audit = (dijkstra if len(kept) < 9 else lambda r, f: repair.solved(signature(r, f)))(roles, faults)
    out, i, last = [], 0, ""
    for edit in audit:
        now = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        role = {"u": "user", "a": "assistant"}[now]
        if edit == "I":
            out.append(f"{role}:")
            last = now
            continue
        if edit != "D":
            out.append(f"{kept[i][1] if edit == 'K' else role}:{kept[i][2]}")
            last = roles[i] if edit == "K" else now
        i += 1
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_against_brute_force(spark):
    convs = {c: [(c, *r) for r in rows] for c, rows in CONVS.items()}
    convs[77] = [(77, k, "user", "gone.") for k in gone(77)]
    rnd = random.Random(3)
    for c in range(100, 160):
        convs[c] = [(c, rnd.choice([k, k, None]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", " ", "c!", "d?\n"])) for k in range(rnd.randint(1, 7))]
    rows = [(*r, "x", 1) for rs in convs.values() for r in rs]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone string, n int").repartition(4)
    out = repair.repaired(repair.damaged(df))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len(got) == len(convs)
    for r in got:
        assert tuple(r)[1:] == slow(convs[r.conv_id]), r.conv_id
    assert tuple(next(r for r in got if r.conv_id == 77))[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(df)).collect() == []


def test_a_signature_is_solved_once(spark):
    rows = spark.range(3000).selectExpr("id DIV 3 AS conv_id", "id % 3 AS turn", "element_at(array('system', 'user', 'assistant'), cast(id % 3 + 1 as int)) role", "concat('text ', id, '.') text", "false gone")
    out = repair.repaired(rows)
    assert {tuple(r)[1:8] for r in out.collect()} == {(0, 0, 0, 0, 0, 0, "KKK")} and out.count() == 1000
