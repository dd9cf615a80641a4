import hashlib
import itertools
import random
import zlib

import pytest

from textloom.llm import conversation_repair as R
from textloom.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string"
STEP = {"Es": "S", "Eu": "U", "Su": "U", "Au": "U", "Ua": "A"}
WHITE = " \t\n\v\f\r"


def kind(row):
    role, _, go, cut = row
    return (R.INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 0) + (R.MUST_GO if go else R.IS_CUT if cut else 0)


def run_of(states, roles):
    for r in roles:
        states = STEP.get(states + r[:1])
        if states is None:
            return None
    return states


def every_audit(rows):
    """(cost, audit, repaired rows) of all edits with up to two inserts in each gap, by trying them all."""
    own = []
    for role, text, go, cut in rows:
        choices = [("D", 2, [])]
        if not go:
            choices += [("K", 5 * cut, [(role, text)])] + [("R", 1 + 5 * cut, [(r, text)]) for r in ("user", "assistant")]
        own.append(choices)
    gaps = [("I" * n, 5 * n, [(r, "") for r in rs]) for n in range(3) for rs in itertools.product(("user", "assistant"), repeat=n)]
    parts = [x for choices in own for x in (gaps, choices)] + [gaps]
    for picked in itertools.product(*parts):
        left = [r for _, _, rs in picked for r in rs]
        if run_of("E", [r for r, _ in left]) in ("E", "A"):
            yield sum(c for _, c, _ in picked), "".join(a for a, _, _ in picked), left


def least_audit(rows):
    """The same by states, for longer conversations: plain strings, inserts before any row."""
    best = {"E": (0, "", [])}

    def with_inserts(front):
        for _ in range(2):
            for state, (cost, audit, left) in list(front.items()):
                role = "assistant" if state == "U" else "user"
                found = (cost + 5, audit + "I", [*left, (role, "")])
                front[STEP[state + role[0]]] = min(found, front.get(STEP[state + role[0]], found))
        return front

    for role, text, go, cut in rows:
        new = {}
        for state, (cost, audit, left) in with_inserts(best).items():
            edits = [(state, 2, "D", [])]
            if not go:
                edits += [(STEP.get(state + role[:1]), 5 * cut, "K", [(role, text)])] + [(STEP.get(state + r[0]), 1 + 5 * cut, "R", [(r, text)]) for r in ("user", "assistant")]
            for end, more, letter, kept in edits:
                if end:
                    found = (cost + more, audit + letter, left + kept)
                    new[end] = min(found, new.get(end, found))
        best = new
    return min(v for s, v in with_inserts(best).items() if s in "EA")


def with_faults(rows):
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        end = text.rstrip(WHITE)
        blank, twice = not end, bool(end) and (role, text) in seen
        cut = not blank and not twice and end[-1] not in ".!?"
        seen.add((role, text))
        counts = [counts[0] + blank, counts[1] + twice, counts[2] + cut]
        out.append((role, text, blank or twice, cut))
    return out, counts


def expected(conversations):
    """Rows of the contract from (conv_id, turn, role, text) before damage."""
    found = {}
    for conv, turn, role, text, *_ in conversations:
        rows, role, text = found.setdefault(conv, []), " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        row = (turn is not None, turn or 0, "user" if fault == 4 else role, text)
        rows += [] if fault == 0 else [row] * (2 if fault == 3 else 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        turns = [r[1] for r in rows if r[0]]
        faults, counts = with_faults([r[2:] for r in rows])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, left = least_audit(faults)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(rng, n):
    out = []
    for _ in range(n):
        go = rng.random() < 0.2
        out.append((rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), "x", go, not go and rng.random() < 0.2))
    return out


def test_audits_are_the_least_of_all():
    rng = random.Random(5)
    for _ in range(40):
        rows = random_rows(rng, rng.randint(0, 3))
        want = min(every_audit(rows))
        assert R.whole_audit(bytes(map(kind, rows))) == want[:2] == least_audit(rows)[:2]


def test_longer_audits_and_their_parts():
    rng = random.Random(6)
    for n in [*range(4, 40), 300]:
        rows = random_rows(rng, n)
        kinds, want = bytes(map(kind, rows)), least_audit(rows)[:2]
        assert R.whole_audit(kinds) == want
        audits, front, at = R.Audits(), {R.EMPTY: (0, 0)}, 0
        while at < n:
            end = at + rng.randint(1, 7)
            front, at = audits.advance(front, R.part_audits(kinds[at:end])), end
        assert audits.finished(front) == want


def test_a_lying_hash_is_found_out(monkeypatch):
    monkeypatch.setattr(R, "_PRIME", 3)
    rng = random.Random(7)
    for n in range(1, 60):
        rows = random_rows(rng, n)
        assert R._worked_out(bytes(map(kind, rows))) == least_audit(rows)[:2]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Hello.", "Hello", "Why? ", "ok.\n", "", None, " \t", f"Word {rng.randint(0, 99)}!", "long " * 300 + "."])
            rows.append((conv, turn * rng.randint(1, 2) if rng.random() > 0.1 else None, role, text, "clash"))
    rows += [(99, t, ("user", "assistant")[t % 2], f"Line {t % 50}.", None) for t in range(600)]
    return [*rows, rows[0], rows[3], rows[3]]


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 7])
def test_conversations(spark, talks, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)  # used in the plan alone
    monkeypatch.setattr(R, "ROWS_PER_TASK", 100)
    frame = spark.createDataFrame(talks, SCHEMA)
    assert got(R.audited(frame, R.damaged(frame))) == expected(talks)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind.", ""), (1, 1, "assistant", "Hi.", ""), (1, 2, "user", "Hi!", ""), (1, 3, "user", "And?", ""), (1, 4, "assistant", "So.", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    left = [(r.at, r.edit, r.role, r.text) for r in R.repaired(frame, R.audits(frame)).orderBy("at").collect()]
    assert [r[0] for r in left] == list(range(len(left))) and run_of("E", [r[2] for r in left]) == "A"


def test_no_conversations_and_only_dropped_ones(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.audited(empty, R.damaged(empty)).count() == 0
    ids = [(c, 0, "user", "a.", "") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    frame = spark.createDataFrame(ids, SCHEMA)
    assert got(R.audited(frame, R.damaged(frame))) == expected(ids) and all(r[7] == "" for r in expected(ids))


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_repaired_conversations(spark, sf)) == expected(rows)


