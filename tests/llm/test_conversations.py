import hashlib
import random
import re
import zlib

from cohortspark.llm.conversations import INSERT, LAST, MOVES, START, Survivors, after, damage, inserts, repair_edits, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, pos string, cost string, edit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def cheapest(rows):
    """(cost, audit) of (initial, truncated, goes) rows by whole strings."""
    best = {START: (0, "")}
    for initial, cut, goes in rows:
        new = {}
        for m, (c, a) in best.items():
            for ins, at in inserts(m):
                ways = [("D", at, 3)]
                if not goes:
                    ways += [("K", after(at, initial), cut), ("R", after(at, "u"), 2 + cut), ("R", after(at, "a"), 2 + cut)]
                for letter, to, cost in ways:
                    key = (c + cost + INSERT * len(ins), a + "I" * len(ins) + letter)
                    if to is not None and (to not in new or key < new[to]):
                        new[to] = key
        best = new
    return min((c + INSERT * len(LAST[m]), a + "I" * len(LAST[m])) for m, (c, a) in best.items())


def report(rows):
    """The contract, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        x = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if h:
                x += [(turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (1 + (h == 3))
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in x if t is not None]
        faults, seen = [], set()
        for _, role, text in x:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[:1], f == "truncated", f in ("blank", "duplicate")) for (_, r, _), f in zip(x, faults)])
        lines, k, places = [], 0, iter(zip(x, faults))
        for e in audit:
            row = next(places)[0] if e != "I" else None
            if e == "D":
                continue
            role = row[1] if e == "K" else ("user", "assistant")[k % 2]
            k = k if role[:1] == "s" and not lines else k + 1
            lines.append(f"{role}:{row[2] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(x, x[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            out.append((c, t if rng.random() < .95 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                        rng.choice(["Hi.", "Yes!", "no", "", None, " \t", "a? ", "same.", f"text {t}.", "é."])))
    return out


def test_survivors_give_the_least_whole_string():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice(rng.choice(["sua", "ua", "u", "suax"])), rng.random() < .2, rng.random() < .2) for _ in range(rng.randint(0, 14))]
        path, moves = Survivors(), []
        for i, cut, goes in rows:
            moves += path.step("goes" if goes else (i if i in "sua" else "", cut))
        cost, last, rest = path.finish()
        assert len(moves + rest) == len(rows)
        assert (cost, "".join(MOVES[m].letters for m in moves + rest) + "I" * len(last)) == cheapest(rows)


def test_edits_leave_early_and_the_tree_stays_small():
    rng, path, most, out = random.Random(6), Survivors(), 0, 0
    for i in range(30_000):
        out += len(path.step(("ua"[i % 2], False) if rng.random() < .9 else "goes"))
        most = max(most, len(path.refs) // 4 - path.first)
    assert most < 100 + 8192 and out > 29_900


def test_report_matches_brute_force(spark):
    rows = made(1, 300) + [(900, None, None, None), (901, 5, "user", "x" * 200_000 + "."), (901, 6, "assistant", "y " * 100_000),
                           (902, -2**63, "user", "a."), (None, 1, "user", "q."), (None, 2, "user", "q."), (7, 3, "user", "Hi."), (7, 3, "user", "Hi.")]
    df = frame(spark, rows)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in repair_report(df, damage(df)).collect()}
    assert got == report(rows)
    assert repair_report(frame(spark, []), damage(frame(spark, []))).collect() == []


def test_long_conversation_of_undecided_ties(spark):
    rows = [(1, t, "user", f"line {t}.") for t in range(20_000)]
    df = frame(spark, rows)
    (got,) = repair_report(df, damage(df)).collect()
    assert len(got["audit"]) > 19_000 and got["cost"] > 15_000
    edits = repair_edits(damage(df))
    turns = [(r["role"], r["text"]) for r in repaired_turns(edits).orderBy("pos", "part").collect()]
    assert [r for r, _ in turns] == ["user", "assistant"] * (len(turns) // 2)
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == got["repaired_sha256"]
