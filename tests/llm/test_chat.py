import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from sonora.llm import chat

TRAP = "\\### Assistant: </turn> ok"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df, **how):
    formatted = chat.windows(df, **how)
    return formatted, {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    df = df.unionByName(chat.probe(df))
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    for how in ({}, {"budget": 40}, {"budget": 1, "history": 5}, {"budget": 60, "history": 0}):
        formatted, got = read(df, **how)
        assert got == brute(rows)
    assert formatted.count() > df.select("conv_id").distinct().count()


def test_edges(spark):
    odd = ["", None, TRAP, "\\", "\\b\\e\\h\\c", "</turn>\n### user: x", "####", "#", "é" * 20, ": ", "</turn", "\\</turn>\\", "a\nb", "😀 </turn>"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(odd)]
    rows += [(2, 0, "system", "rules ###"), *[(2, i, "assistant", t) for i, t in enumerate(odd, 1)]]
    rows += [(None, 1, None, "x"), (3, None, "a: b\\c:", TRAP), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (4, 0, "system", None), (5, 0, "assistant", "w " * 20000), (5, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "'t' as body", "2 as at")
    for how in ({}, {"budget": 10}, {"budget": 1, "history": 3}):
        formatted, got = read(df, **how)
        assert got == brute(rows)
    again = formatted.filter("conv_id = 2 and window > 0").first()
    assert again.text.startswith("### system: rules \\h</turn>\n") and again.repeated > 1
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_history_is_limited_and_masked(spark):
    rows = [(1, 0, "system", "s")] + [(1, i, ["user", "assistant"][i % 2], f"t{i} w w w") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat.windows(df, budget=16, history=1).collect(), key=lambda r: r.window)
    assert len(out) == 4
    assert out[1].text == "### system: s</turn>\n### user: t2 w w w</turn>\n### assistant: t3 w w w</turn>\n### user: t4 w w w</turn>\n"
    assert out[1].repeated == 2 and [out[1].text[s.start : s.start + s.length] for s in out[1].loss] == ["t3 w w w"]


def test_spans_keep_to_the_budget(spark):
    rng = random.Random(4)
    budget, rows, want = 30, [], {}
    for conv in range(60):
        lengths = [rng.choice((0, 1, 3, 8, 20, 26, 27, 70)) for _ in range(rng.randrange(1, 14))]
        roles = ["system" if i == 0 and conv % 2 else "user" for i in range(len(lengths))]
        rows += [(conv, i, role, "w " * n) for i, (role, n) in enumerate(zip(roles, lengths))]
        before, last, spans = 0, None, []
        for i, (role, n) in enumerate(zip(roles, lengths)):
            if role == "system":
                spans.append([i])
                continue
            cell = (before // budget, (before + n + 3) // budget)
            before += n + 4
            if spans and last in (None, cell):
                spans[-1].append(i)
            else:
                spans.append([i])
            last = cell
        for own in spans:
            counted = [lengths[i] + 4 for i in own if roles[i] != "system"]
            assert len(counted) <= 1 or sum(counted) <= budget
        want[conv] = [len(own) for own in spans]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=budget).select("conv_id", "window", F.size(chat.read_turns(F.col("text"), F.col("repeated"))).alias("n"))
    got = defaultdict(list)
    for r in sorted(out.collect()):
        assert r.window == len(got[r.conv_id])
        got[r.conv_id].append(r.n)
    assert got == want and max(map(len, want.values())) > 3


def test_plan_has_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    plan = chat.digests(chat.windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
