"""Operator 12 against an exhaustive search, on groups and on pieces of long conversations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from punctuality.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, copy int, at string, fault string"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, audit) from every state, by trying everything from the end on."""
    def closed(best):
        for _ in range(4):
            for state in list("sua") + [""]:
                to = "a" if state == "u" else "u"
                if to in best:
                    offer = best[to][0] + 3, "I" + best[to][1]
                    best[state] = min(best.get(state, offer), offer)
        return best

    best = closed({"": (0, ""), "a": (0, "")})
    for initial, fault in reversed(list(zip(initials, faults, strict=True))):
        new, extra = {}, 3 * (fault == "truncated")
        for state in ["", "s", "u", "a"]:
            offers = []
            if state in best:
                offers.append((best[state][0] + 4, "D" + best[state][1]))
            if fault not in ("blank", "duplicate"):
                to = MOVES.get((state, initial))
                if to in best:
                    offers.append((best[to][0] + extra, "K" + best[to][1]))
                other = "a" if state == "u" else "u"
                if other in best:
                    offers.append((best[other][0] + 3 + extra, "R" + best[other][1]))
            if offers:
                new[state] = min(offers)
        best = closed(new)
    return best[""]


def order(row):
    return tuple((x is not None, x or (0 if i == 1 else "")) for i, x in enumerate(row) if i)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damage(sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0),)))
        own.sort(key=lambda r: ((r[1] is not None, r[1] or 0), r[2], r[3]))
        faults = faults_of(own)
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(initials, faults)
        repaired, state, i = [], "", 0
        for edit in audit:
            other = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[other]
            if edit == "I":
                repaired.append(f"{name}:")
                state = other
                continue
            if edit == "R":
                repaired.append(f"{name}:{own[i][3]}")
                state = other
            if edit == "K":
                repaired.append(f"{own[i][2]}:{own[i][3]}")
                state = own[i][2][:1]
            i += 1
        assert i == len(own)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in repaired))
        out[conv] = (
            gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def rows_of(seed, sizes):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "so it goes", "\n ", "", "What? ", "é?\t", "ok.\x0b", None, "a" * 3000 + "."]
    out = []
    for conv, size in enumerate(sizes):
        style = rng.choice(["mixed", "users", "plain"])
        for t in range(size):
            plain = ["user", "assistant"][t % 2]
            role = {"plain": plain, "users": "user"}.get(style) or rng.choice([plain, plain, "system", "user", "tool", None, ""])
            text = rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(9**5)}."
            turn = None if rng.random() < 0.03 else t + (t > 5) * 3 - (rng.random() < 0.05)
            out.append((conv if conv else None, turn, role, text))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)


def got(df):
    found = df.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_short_conversations(spark):
    rows = rows_of(1, [1, 2, 3, 30] + [random.Random(2).randrange(1, 12) for _ in range(300)])
    wanted = brute(rows)
    assert got(C.repair_digest(frame(spark, rows))) == wanted
    assert any(w[6] == "" for w in wanted.values()) and any("I" in w[6] for w in wanted.values())


def test_long_conversations_in_pieces(spark):
    rows = rows_of(5, [40, 90, 3, 61, 7, 120, 2])
    rows += [(99, 5, "user", "same.")] * 70  # equal rows are split, too
    rows += [(98, t, "user", f"n{t}.") for t in range(80)]  # costs never converge here
    assert got(C.repair_digest(frame(spark, rows), piece=8)) == brute(rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(C.repair_digest(table)) == brute(rows)


def test_empty_table_and_rows_that_all_go(spark):
    assert C.repair_digest(frame(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = C.repair_digest(frame(spark, [(gone, 0, "user", "Hi.")])).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_costs_do_not_depend_on_chunks(chunk):
    rng = random.Random(7)
    sizes = [rng.randrange(1, 60) for _ in range(40)]
    n, ends = sum(sizes), np.cumsum(sizes)
    rows = C.Rows([rng.choice("sua ") for _ in range(n)], np.array([rng.random() < 0.1 for _ in range(n)]), np.array([rng.random() < 0.2 for _ in range(n)]))
    at_end = np.tile(C._END, (len(ends), 1))
    assert (C.costs_to_come(rows, ends, at_end, chunk) == C.costs_to_come(rows, ends, at_end, 10**6)).all()


def test_responses_give_the_costs_of_a_run():
    rng = random.Random(9)
    rows = C.Rows([rng.choice("sua") for _ in range(50)], np.array([rng.random() < 0.1 for _ in range(50)]), np.array([rng.random() < 0.2 for _ in range(50)]))
    end = C._inserted(C._END)
    direct = C.costs_to_come(rows, np.array([50]), C._END[None])[0]
    assert (C._shape(C._inserted((end[:, None] + C.responses(rows)).min(0))) == direct).all()
