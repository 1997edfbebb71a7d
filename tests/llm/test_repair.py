"""Operator 13 against a plain version of its contract."""

import hashlib
import random
import re
import uuid
import zlib
from itertools import product

import pytest

from claimtext.llm import repair
from claimtext.llm.queries import repaired
from claimtext.session import ensure_checkpoint_dir
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def broken(rows):
    out = []
    for c, t, role, text in rows:
        c_, t_, role, text = (" " if x is None else x for x in (c, t, role, text))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def kinds(rows):
    """(initial, fault) of rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(marks):
    """Every state's least (cost, edits, initials), row by row, with inserts before each and at the end."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ways):
        for _ in range(4):
            for (p, r), q in step.items():
                if r != "s" and p in ways:
                    c, e, out = ways[p]
                    ways[q] = min(ways.get(q, (10**9,)), (c + 5, e + "I", out + r))
        return ways

    ways = {"": (0, "", "")}
    for initial, fault in marks:
        new = {}
        for p, (c, e, out) in inserted(ways).items():
            options = [(p, c + 2, "D", "")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options += [(step[p, r], c + cost + more, x, r) for r, cost, x in
                            ((initial, 0, "K"), ("u", 1, "R"), ("a", 1, "R")) if (p, r) in step]
            for q, cost, x, r in options:
                new[q] = min(new.get(q, (10**9,)), (cost, e + x, out + r))
        ways = new
    ways = inserted(ways)
    return min(ways[q] for q in ("", "a") if q in ways)


def plain(rows):
    out = {}
    after = broken(rows)
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
        own = sorted([r for r in after if r[0] == conv], key=key)
        marks = kinds(own)
        cost, audit, made = cheapest(marks)
        lines, at = [], 0
        roles = iter(made)
        for x in audit:
            if x == "I":
                lines.append({"u": "user:", "a": "assistant:"}[next(roles)])
                continue
            _, _, role, text = own[at]
            at += 1
            if x != "D":
                new = next(roles)
                lines.append(f"{role if x == 'K' else {'u': 'user', 'a': 'assistant'}[new]}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        count = [f for _, f in marks].count
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"),
                     count("truncated"), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    names = [*repair.REPORT, "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \t\n", "Why?", "Well... \n", None, "é!", "漢字", "A. B! c"]
    roles = ["system", "user", "assistant", "tool", "", None, "User", "unknown"]
    rows = [(c, t if rng.random() < .9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < .4 else f"t{rng.random()}.")
            for c in range(1000, 1150) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (2000, None, "user", "x")]
    rows += [(3000, 7, "user", "same.")] * 30  # rows equal in every column
    rows += [(3001, t // 2, roles[t % 3], f"m{t % 50}{'.' * (t % 3)}") for t in range(600)]  # one long conversation
    return rows + [(4000, t, "user", "only user.") for t in range(40)]


@pytest.mark.parametrize("segment", [repair.SEGMENT, 8])
def test_repair_is_that_of_the_contract(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    given = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = given + odd_rows()
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(repaired(df)) == want


def test_every_short_sequence_against_all_edits():
    """Symbols of all sequences up to three rows: no cheaper or earlier edits among all of bounded length."""
    matrices = repair.rule_matrices([])
    fault = {"D": ("u", "blank"), "o": ("t", ""), "O": ("t", "truncated")}
    for n in range(1, 4):
        for symbols in product(repair.BASE, repeat=n):
            marks = [fault.get(x, (x.lower(), "truncated" if x.isupper() else "")) for x in symbols]
            best = None
            for edits in product("DKR", repeat=n):
                slots = [["", *("I" * k for k in (1, 2, 3))]] * (n + 1)
                for inserts in product(*slots):
                    audit = inserts[0] + "".join(x + i for x, i in zip(edits, inserts[1:]))
                    cost, state, ok, at = 0, 0, True, 0
                    for x in audit:
                        if x == "I":
                            cost, state = cost + 5, {0: 2, 1: 2, 2: 3, 3: 2}[state]
                            continue
                        initial, f = marks[at]
                        at += 1
                        if x == "D":
                            cost += 2
                            continue
                        role = initial if x == "K" else "a" if state == 2 else "u"
                        ok = ok and f != "blank" and (state, role) in repair.STEP
                        if not ok:
                            break
                        state = repair.STEP[state, role]
                        cost += (x == "R") + 5 * (f == "truncated")
                    if ok and state in (0, 3):
                        best = min(best or (cost, audit), (cost, audit))
            whole = repair.product(repair.evaluate("".join(symbols), matrices), repair.INSERTS)
            found = min((whole[q][0], repair.flat(whole[q][1])) for q in (0, 3) if whole[q])
            assert found == best, symbols


def test_rules_and_rows(spark):
    """Rules are learnt and shared, the compressed product is that of the rows, the real rows come out."""
    rng = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2] if rng.random() < .9 else "tool", f"Text {c} {t}.") for c in range(200) for t in range(20)]
    folder = f"{ensure_checkpoint_dir(spark)}/repair-test-{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seg", repair.F.lit("clash")).withColumn("kinds", repair.F.lit(1))
    report, out = repair.repair(df, folder)
    cut = spark.read.parquet(folder)
    seqs = repair.sequences(cut)
    rules = repair.learn_rules(seqs)
    symbols = [r.symbols for r in seqs.collect()]
    short = repair.compressed("\n".join(symbols), rules).split("\n")
    assert len(rules) > 10 and sum(map(len, short)) < 0.35 * sum(map(len, symbols))
    matrices = repair.rule_matrices(rules)
    for x, y in zip(symbols, short):
        assert repair.evaluate(x, matrices) == repair.evaluate(y, matrices)
    want = {r.conv_id: r.audit for r in report.collect()}
    roles = {}
    for r in out.orderBy("conv_id", "position").collect():
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
    assert len(want) == 200 and all(GOOD.fullmatch(x) for x in roles.values())
    assert {c: len(a) - a.count("D") for c, a in want.items()} == {c: len(roles.get(c, "")) for c in want}


def test_empty_table(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)).count() == 0
