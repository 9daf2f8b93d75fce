import hashlib
import random
import re

import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from trouble import documents, empty

from sheaf.llm import chat, licenses, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, name):
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op6_license_scan", "op9_chat_format"])
def test_no_python_on_the_way(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


TURNS = "conv_id long, turn long, role string, text string, _conv int, segments string, state string"
NASTY = ["\\", "</turn>", "### User: x</turn>\n", "\\\\</turn", "a\\", "", None, "<\\/turn>", "#\\## ", "é\n\n</turn>\n### Assistant: "]


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "t") for r in rows], TURNS)


def test_texts_come_back(spark):
    rows = [(k, i, r, t) for k in range(3) for i, (r, t) in enumerate((r, NASTY[(i + k) % len(NASTY)]) for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "tool: a", None, "assistant", "user", "="]))]
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns(spark, rows))).collect()}
    for k, chats in found.items():
        own = [(r or "", t or "") for c, _, r, t in rows if c == k]
        assert [(t.role, t.text) for t in chats.turns] == own
        assert chats.loss_text == "".join(t for r, t in own if r == "assistant")
        assert chats.formatted == "".join(s.text for s in chats.segments) and chats.n_turns == len(own)
        assert not chats.valid


@pytest.mark.parametrize(("roles", "state"), [("sua", "answered"), ("u", "asked"), ("s", "ready"), ("uaua", "answered"), ("a", "error"), ("uu", "error"), ("us", "error"), ("sus", "error")])
def test_machine(spark, roles, state):
    names = {"s": "system", "u": "user", "a": "assistant"}
    row = chat.format_chats(turns(spark, [(1, i, names[r], "t") for i, r in enumerate(roles)])).first()
    assert (row.state, row.valid) == (state, state != "error")


def test_long_chat_over_blocks(spark):
    rows = spark.range(2000).select(F.lit(5).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.read_chats(chat.format_chats(rows.withColumnRenamed("id", "turn").repartition(7))).first()
    assert [t.text for t in row.turns] == [str(i) for i in range(2000)] and row.valid and row.state == "answered"
    assert hashlib.sha256(row.loss_text.encode()).digest() == hashlib.sha256("".join(str(i) for i in range(1, 2000, 2)).encode()).digest()


def test_chat_trouble(spark):
    rows = [(1, None, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "user", "n"), (2, -3, "assistant", "y")]
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns(spark, rows))).collect()}
    assert [t.text for t in found[1].turns] == ["b", "a", "a"] and found[None].n_turns == 1 and found[2].loss_text == "y"
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_licenses(spark):
    long = "word " * 3000
    rows = [(1, "Released under the MIT license"), (2, f"{long} licensed UNDER the Apache License, version 2.0! {long}"), (3, "Licensed under CC BY-NC"), (4, None), (5, ""), (1, "Released under the MIT license"), (6, "This work is licensed under the GNU General Public License version 3")]
    found = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert found[1, "MIT"] == (1.0, 0) and found[2, "Apache-2.0"][0] == 1.0 and 2990 < found[2, "Apache-2.0"][1] <= 3001
    assert found[6, "GPL-3.0"][0] == 1.0 and {d for d, _ in found} == {1, 2, 6}
    assert licenses.license_matches(empty(spark)).count() == 0 == licenses.license_matches(documents(spark, rows), templates=()).count()


def test_long_licenses(spark):
    whole = {name: text for name, text in licenses.TEMPLATES if len(text.split()) > 25}
    assert len(whole) >= 9
    rows = [(i, "some words before it " * (i % 4) + text.upper().replace(",", " ,\n") + " and after" * i) for i, text in enumerate(whole.values())]
    torn = whole["MIT"].split()
    rows += [(100, " ".join(w for k, w in enumerate(torn) if k % 60 != 30)), (101, " ".join(torn[: len(torn) // 4][::-1]))]
    found = {(r.doc_id, r.license): r.containment for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert all(found[i, name] == 1.0 for i, name in enumerate(whole))
    assert 0.8 <= found[100, "MIT"] <= 1 and 101 not in {d for d, _ in found}


def test_damaged_licenses_are_found_at_the_promised_share(spark):
    """Copies of each template with words replaced at random, within long texts: of those that still hold 0.8 of its shingles all but a few in 10,000 may be missed."""
    chosen = random.Random(7)
    templates = {i: (name, re.findall(r"[^\W_]+", text.lower())) for i, (name, text) in enumerate(licenses.TEMPLATES)}
    filler = [f"filler{i}" for i in range(400)]
    shingles = lambda words: {tuple(words[i : i + licenses.SHINGLE]) for i in range(len(words) - licenses.SHINGLE + 1)}
    rows, near, far = [], set(), set()
    for i, (name, words) in templates.items():
        for k in range(12):
            torn = [f"changed{chosen.random()}" if chosen.random() < k / 300 else w for w in words]
            text = chosen.choices(filler, k=chosen.randrange(300)) + torn + chosen.choices(filler, k=chosen.randrange(300))
            doc = i * 100 + k
            rows.append((doc, " ".join(text)))
            for other, own in templates.values():
                held = len(shingles(own) & shingles(text)) / len(shingles(own))
                (near if held >= licenses.MIN_CONTAINMENT else far).add((doc, other))
    found = {(r.doc_id, r.license) for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert len(near) > 200 and any(k % 100 for k, _ in near)
    assert not found - near  # containment is exact, so nothing below the share is reported
    assert len(near - found) <= len(near) / 1000


def test_filter_admits_all_of_its_hashes(spark):
    hashes = [-(2**63), -1, 0, 5, 2**63 - 1, 0x123456789ABCDEF]
    bits = licenses.shingle_filter(hashes)
    rows = spark.createDataFrame([(h,) for h in [*hashes, 6, 7, -9]], "h long").select(licenses.passes(bits, F.col("h"))).collect()
    assert [r[0] for r in rows][:6] == [True] * 6 and not all(r[0] for r in rows)
