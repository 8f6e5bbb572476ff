import hashlib
import random

import pytest

from rulemill.llm import conversations
from rulemill.llm.conversations import BLANK, DUPLICATE, TRUNCATED, Costs, cheapest, damaged, repair, repaired_reports, report

SCHEMA = "conv_id long, turn long, role string, text string, seq string, audit int, fault string, n int"


def brute(rows, costs, insertions):
    """All edit sequences with a bounded number of insertions; the least (cost, audit)."""
    after = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    best = []

    def go(rest, last, cost, audit, left):
        following = "a" if last == "u" else "u"
        if not rest and last in ("", "a"):
            best.append((cost, audit))
        if left:
            go(rest, following, cost + costs.insert, audit + "I", left - 1)
        if rest:
            (initial, fault), more = rest[0], rest[1:]
            go(more, last, cost + costs.delete, audit + "D", left)
            if fault not in (BLANK, DUPLICATE):
                extra = costs.truncated * (fault == TRUNCATED)
                go(more, following, cost + costs.rerole + extra, audit + "R", left)
                if (initial, last) in after:
                    go(more, initial, cost + extra, audit + "K", left)

    go(rows, "", 0, "", insertions)
    return min(best)


def drawn(rng, n):
    return [(rng.choice("suax "), rng.choice([0, 0, 0, BLANK, DUPLICATE, TRUNCATED])) for _ in range(n)]


def test_cheapest_repair_equals_brute_force():
    rng = random.Random(1)
    for t in range(300):
        n = rng.randrange(5)
        costs = Costs() if t % 2 else Costs(rng.randrange(4), rng.randrange(5), rng.randrange(1, 4), rng.randrange(4))
        rows = drawn(rng, n)
        assert cheapest(rows, costs) == brute(rows, costs, 3 if t % 2 else 6)
    assert cheapest([("u", 0)], Costs(insert=1, delete=4)) == (1, "KI")


def test_digits_put_away_change_nothing(monkeypatch):
    rng = random.Random(2)
    cases = [(drawn(rng, rng.randrange(60)), Costs() if i % 2 else Costs(1, 3, 2, 1)) for i in range(60)]
    whole = [cheapest(*case) for case in cases]
    monkeypatch.setattr(conversations, "_BLOCK", 3)
    assert [cheapest(*case) for case in cases] == whole


def test_long_conversation_takes_short_integers():
    cost, audit = cheapest([("u", 0)] * 20_001)
    assert cost == 10_002 and len(audit) == 20_001 and audit[:5] == "DKRKR" and set(audit[1:]) == {"K", "R"}


def test_costs_are_checked():
    with pytest.raises(ValueError):
        Costs(insert=0)


def rows_of(frame):
    return {r["conv_id"]: r for r in frame.collect()}


def test_reports_and_rows(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 5, "user", "Hi."), (1, 6, "assistant", "And\n"),
        (2, 3, "user", "A?"), (2, 4, "user", "B!"),
        (3, 0, "user", " \t"), (3, 1, "assistant", None), (3, None, None, "x."),
        (None, 1, "user", "Q."), (None, 1, "user", "Q."), (None, 2, "assistant", "Z. "),
    ]
    df = spark.createDataFrame([(*r, "s", 1, "f", 2) for r in rows], SCHEMA).repartition(3)
    found = report(df)
    got = {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for k, r in rows_of(found).items()}
    assert got == {
        1: (2, 0, 1, 1, 0, 4, "KKKDD"), 2: (0, 0, 0, 0, 1, 1, "KR"), 3: (0, 2, 0, 0, 1, 6, "DDD"), None: (0, 0, 1, 0, 1, 2, "KDK"),
    }
    edits = repair(df, found).collect()
    kept = {}
    for r in sorted(edits, key=lambda r: (str(r["conv_id"]), r["seq"])):
        if r["edit"] != "D":
            kept.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert kept == {1: ["system:Be brief.", "user:Hi.", "assistant:Hello."], 2: ["user:A?", "assistant:B!"], None: ["user:Q.", "assistant:Z. "]}
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repaired_reports(df, df).collect()}
    assert digests == {k: hashlib.sha256("\n".join(kept.get(k, [])).encode()).hexdigest() for k in (1, 2, 3, None)}


def test_insertions_are_rows(spark):
    df = spark.createDataFrame([(7, 1, "user", "A.", "", 0, "", 0), (7, 2, "user", "B.", "", 0, "", 0)], SCHEMA)
    dear = Costs(rerole=9, delete=9, insert=1)
    edits = sorted((r["seq"], r["edit"], r["turn"], r["role"], r["text"]) for r in repair(df, report(df, dear)).collect())
    assert edits == [(0, "K", 1, "user", "A."), (1, "I", None, "assistant", ""), (2, "K", 2, "user", "B."), (3, "I", None, "assistant", "")]


def test_whole_conversations_may_be_dropped(spark):
    import zlib

    lost = next(i for i in range(1000) if zlib.crc32(b"%d:4" % i) % 20 == 0)
    df = spark.createDataFrame([(lost, 4, "user", "A.", "", 0, "", 0)], SCHEMA)
    assert damaged(df).count() == 0
    (row,) = repaired_reports(df, damaged(df)).collect()
    assert (row["conv_id"], row["cost"], row["audit"], row["repaired_sha256"]) == (lost, 0, "", hashlib.sha256().hexdigest())
    assert repaired_reports(df.limit(0), df.limit(0)).collect() == []
