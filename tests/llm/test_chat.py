import hashlib

from pyspark.sql import functions as F

from sanguine.llm import chat

CONVS = {
    -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    1: [("system", "be kind"), ("user", "hi & <b> &amp; &lt; [x] \n\\ é😀"), ("assistant", ""), ("user", None), ("assistant", " two  ")],
    2: [("assistant", "first")],
    3: [("user", "a"), ("user", "b"), ("assistant", "c")],
    4: [(None, "x"), ("tool]<", "y"), ("", None), ("user", "<<SYS>> [ROLE:z]")],
    5: [("user", "x" * 100_000), ("assistant", "[/INST]</s>" * 5000)],
    6: [("user", "question without an answer")],
}


def frame(spark):
    rows = [(c, k, role, text, 0) for c, turns in CONVS.items() for k, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "no id", 0), (7, None, "user", "null turn", 0), (7, 1, "assistant", "b", 0), (7, 1, "assistant", "a", 0), (7, 1, "assistant", "a", 0)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int").repartition(3)


def test_round_trip_and_loss(spark):
    out = chat.formatted(frame(spark))
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    want = CONVS | {None: [("user", "no id")], 7: [("user", "null turn"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]}
    assert set(got) == set(want)
    for c, turns in want.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    lengths = {r.conv_id: (r.n, r.m) for r in out.select("conv_id", F.length("formatted").alias("n"), F.aggregate("segments", F.lit(0), lambda a, s: a + F.length(s["text"])).alias("m")).collect()}
    assert all(got[c].formatted_chars == n == m for c, (n, m) in lengths.items())


def test_machine(spark):
    valid = {r.conv_id: r.valid for r in chat.formatted(frame(spark)).select("conv_id", "valid").collect()}
    assert valid == {-1: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False, None: False, 7: False}


def test_no_mark_in_texts(spark):
    bare = chat.formatted(frame(spark)).select(F.explode("segments").alias("s")).filter("s.loss").select("s.text").collect()
    assert bare and not any(c in r.text for r in bare for c in "<[")


def test_native_plan_and_empty(spark):
    df = chat.digest(chat.formatted(frame(spark)))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    assert chat.digest(chat.formatted(frame(spark).limit(0))).collect() == []
