import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("fleetroll.llm")

from fleetroll.llm import dialogues  # noqa: E402

LEGAL = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"u": "user", "a": "assistant"}
WS = " \t\n\x0b\x0c\r"
TERMS = "conv_id long, turn long, role string, text string"


def faults(rows):
    """blank, duplicate, truncated or none of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def ways(rows, most):
    """Every way of editing the rows with at most ``most`` inserted before each row and at the end."""
    inserts = [[(("I", NAMES[r], "") for r in w)] and tuple(("I", NAMES[r], "", 3) for r in w) for k in range(most + 1) for w in itertools.product("ua", repeat=k)]
    choices = []
    for (role, text), fault in zip(rows, faults(rows)):
        more = 3 if fault == "truncated" else 0
        own = [("D", None, None, 4)]
        if fault not in ("blank", "duplicate"):
            own += [("K", role, text, more), *(("R", NAMES[r], text, 3 + more) for r in "ua")]
        choices += [inserts, [(x,) for x in own]]
    for way in itertools.product(*choices, inserts):
        yield [x for part in way for x in part]


def by_brute_force(rows, most):
    best = None
    for way in ways(rows, most):
        kept = [(r, t) for _, r, t, _ in way if r is not None]
        if LEGAL.match("".join(r[:1] or "-" for r, _ in kept)):
            own = (sum(c for *_, c in way), "".join(x[0] for x in way), "\n".join(f"{r}:{t}" for r, t in kept))
            best = min(best or own, own)
    return best


def by_steps(rows):
    """The same by a plain table over rows and states, for longer conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    relax = lambda d, q, way: d.__setitem__(q, min(d.get(q, way), way))

    def inserted(d):
        for _ in range(3):
            for (q, r), to in step.items():
                if q in d and r in NAMES:
                    c, a, out = d[q]
                    relax(d, to, (c + 3, a + "I", (*out, NAMES[r] + ":")))
        return d

    d = inserted({0: (0, "", ())})
    for (role, text), fault in zip(rows, faults(rows)):
        new, more = {}, 3 if fault == "truncated" else 0
        for q, (c, a, out) in d.items():
            relax(new, q, (c + 4, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if (q, role[:1]) in step:
                relax(new, step[q, role[:1]], (c + more, a + "K", (*out, f"{role}:{text}")))
            for r in "ua":
                if (q, r) in step:
                    relax(new, step[q, r], (c + 3 + more, a + "R", (*out, f"{NAMES[r]}:{text}")))
        d = inserted(new)
    c, a, out = min(d[q] for q in (0, 3) if q in d)
    return c, a, "\n".join(out)


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "assistant", "system", " ", "tool", ""]), rng.choice(["Yes.", "No", " \n", "", "Well!", f"t{rng.randrange(9)}?", "x . "])) for _ in range(n)]


def test_lattice_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(0, 3))
        want = by_brute_force(rows, 2)
        assert by_steps(rows) == want
    numbers = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(400):
        rows = some_rows(rng, rng.randint(0, 25))
        cost, audit = dialogues.cheapest([(r[:1], numbers[f]) for (r, _), f in zip(rows, faults(rows))], 0, (0, 3))
        repaired = "\n".join(f"{r}:{t}" for r, t in dialogues.replayed(rows, audit, 0)[0])
        assert (cost, audit, repaired) == by_steps(rows)


def damaged(rows):
    out = []
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [] if d == 0 else [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def want_report(conversations, rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), turn, role, text))
    for conv in {r[0] for r in conversations}:
        own = sorted(by[conv], key=lambda r: (r[0], r[2].encode(), r[3].encode()))
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = [(r, t) for *_, r, t in own]
        f = faults(pairs)
        cost, audit, repaired = by_steps(pairs)
        initials = [r[:1] for r, _ in pairs]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


@pytest.mark.parametrize("most", [128, 3, 1])
def test_report(spark, most):
    """Nulls, repeated rows and turns, empty roles, long conversations in many runs, one with a third of all rows, ids without rows left."""
    rng = random.Random(most)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(some_rows(rng, rng.randint(1, 12)))]
    rows += [(1000, t // 2, *r) for t, r in enumerate(some_rows(rng, 300))]
    rows += [(None, t, *r) for t, r in enumerate(some_rows(rng, 6))] + [(61, None, *r) for r in some_rows(rng, 4)]
    rows += [(62, None, None, None), (62, 5, None, "Hm."), (62, 9, "user", None), *rows[:5]]
    rows += [(next(c for c in range(2000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone.")]
    given = spark.createDataFrame(rows, TERMS).repartition(5)
    got = {tuple(r) for r in dialogues.report(given, dialogues.damaged(given), most).collect()}
    assert got == set(want_report(rows, damaged(rows)))


def test_report_of_nothing(spark):
    given = spark.createDataFrame([], TERMS)
    assert dialogues.report(given, dialogues.damaged(given)).collect() == []
    given = spark.createDataFrame([(1, 1, "user", "Yes.", "_k", 5)], TERMS + ", _k string, fault int")
    assert [tuple(r)[:8] for r in dialogues.report(given, given.limit(0)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
