import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sonora.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = (text or "").split("\n")
    again = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text("ab \n\té#\x1c\x85\u2003", max_size=60), st.text(max_size=30)))
def test_measures_against_brute_force(text):
    assert quality.measure(text)[:5] == brute(text)


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    texts = [(1, None), (2, ""), (3, good), (4, "same three words " * 40), (5, good.upper()), (6, good), (None, good), (7, "## $$ " * 60), (8, good * 800)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n_words", "true as kept")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert rows[3].kept and rows[6].kept and rows[None].kept and rows[8].base_failed
    assert rows[1].base_failed and rows[2].base_failed and rows[4].base_failed
    assert not rows[5].kept and rows[5].failed == ["upper_case"] and not rows[5].base_failed
    assert "symbols" in rows[7].failed
    entries = quality.ledger(docs)
    report = {r.rule: r for r in quality.ablation(entries, "web-2").collect()}
    bits = [r.fail_bits for r in entries.collect()]
    for r in quality.RULES:
        own = [b & quality.POLICIES["web-2"] for b in bits if b & 1 << r.bit]
        assert report[r.name].n_failed == len(own)
        assert report[r.name].n_alone == sum(b == 1 << r.bit for b in own)
    assert quality.ablation(entries.limit(0), "web-2").count() == len(quality.RULES)
    assert quality.judge(docs.limit(0)).count() == 0
