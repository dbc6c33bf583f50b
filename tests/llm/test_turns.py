import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidebar.llm import turns

ROWS = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest, then ASCII-least audit of all edit sequences with up to two insertions in a gap, and its turns."""
    what, best = faults(rows), None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(w in ("blank", "duplicate") and x != "D" for w, x in zip(what, letters, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, letters, strict=False)) + "I" * gaps[-1]
            cost = sum({"D": 2, "K": 0, "R": 1, "I": 5}[x] for x in audit) + sum(5 for w, x in zip(what, letters, strict=True) if w == "truncated" and x != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            for named in itertools.product(["user", "assistant"], repeat=audit.count("R") + audit.count("I")):
                k, name, out = iter(rows), iter(named), []
                for x in audit:
                    if x == "I":
                        out.append((next(name), ""))
                    else:
                        role, text = next(k)
                        if x != "D":
                            out.append((next(name) if x == "R" else role, text))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    best = (cost, audit, out)
    return best


def sha(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def chats(seed, n, most):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randrange(1, most + 1)):
            turn += rng.choice([1, 1, 1, 2, 0])
            out.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "Hi.", "ok!", "so?", "cut off", " \n", "", "yes. ", None])))
    return out


def of(rows):
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    return by


@pytest.mark.parametrize(("stretch", "fold"), [(512, 64), (1, 2), (2, 2)])
def test_against_all_edits(spark, stretch, fold):
    rows = chats(1, 120, 4)
    out = {r["conv_id"]: r for r in turns.repair_digest(spark.createDataFrame(rows, ROWS).repartition(3), stretch, fold).collect()}
    for c, taken in of(rows).items():
        plain = [(role, text) for _, role, text in taken]
        cost, audit, repaired = brute(plain)
        what, r = faults(plain), out[c]
        initials = [role[:1] for role, _ in plain]
        times = [t for t, *_ in taken]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, sha(repaired)), plain
        assert [r[x] for x in ("blank", "duplicate", "truncated")] == [what.count(x) for x in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert r["gaps"] == max(times) - min(times) + 1 - len(set(times))


def test_long_conversations_in_stretches(spark):
    """The same rows at any length of a stretch, and turns that are what the hash is of."""
    rng = random.Random(7)
    rows = [(c, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"line {rng.randrange(200)}.", "cut", "Same."])) for c in (1, 2, None) for k in range(257 + (c or 0))]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    want = {r["conv_id"]: r for r in turns.repair_digest(df).collect()}
    for stretch, fold in ((16, 3), (64, 64), (257, 2)):
        assert {r["conv_id"]: r for r in turns.repair_digest(df, stretch, fold).collect()} == want
        got = {}
        for r in turns.repaired_turns(df, stretch, fold).orderBy("conv_id", "part", "place").collect():
            got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert {c: sha(x) for c, x in got.items()} == {c: r["repaired_sha256"] for c, r in want.items()}


def test_ties_go_to_the_least_audit():
    user, assistant, system = ("u", None), ("a", None), ("s", None)
    solve = lambda *rows: turns.lightest([turns.deductions(*r) for r in rows], turns.START, goals=turns.ENDS)
    only = lambda found: next(iter(found.values()))[:2]
    assert only(solve()) == (0, "")
    assert only(solve(user)) == (2, "D")
    assert only(solve(user, user)) == (1, "KR")
    assert only(solve(system)) == (2, "D")
    assert only(solve(system, user, assistant)) == (0, "KKK")
    assert only(solve(user, user, assistant)) == (2, "DKK")
    assert only(solve(assistant, user)) == (2, "RR")


def test_damage_and_odd_cases(spark, clashing):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t}. Why? No!") for c in range(40) for t in range(6)] + [(None, None, None, None), (None, 3, "user", "x."), (77, None, "user", "y.")]
    got = sorted(map(tuple, turns.damaged(clashing(spark.createDataFrame(rows, ROWS))).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        want += [(c, t, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    assert got == sorted(want, key=repr)
    assert turns.repair_digest(spark.createDataFrame([], ROWS)).count() == 0
    nothing = turns.repair_digest(clashing(spark.createDataFrame([(5, None, None, None)], ROWS))).collect()
    assert [tuple(r) for r in nothing] == [(5, 0, 1, 0, 0, 0, 2, "D", sha([]))]
