import itertools
import random

import pytest

from kinframe.llm import chat

KIND = {"system": 0, "user": 1, "assistant": 2}


def brute(kinds):
    """Least cost over all ways to label the turns."""
    best = chat.NEVER
    for walk in itertools.product((1, 2, 3), repeat=len(kinds)):
        s, cost = chat.START, 0
        for k, t in zip(kinds, walk):
            cost += int(chat.COST[k, s, t])
            s = t
        best = min(best, cost + int(chat.END_COST[s]))
    return best


def cost_of(kinds, states):
    return sum(int(chat.COST[k, s, t]) for k, s, t in zip(kinds, states, states[1:])) + int(chat.END_COST[states[-1]])


def test_repair_is_cheapest():
    for n in range(1, 7):
        for kinds in itertools.product(range(4), repeat=n):
            states = chat.solve(bytes(kinds))
            assert states[0] == chat.START and cost_of(kinds, states) == brute(kinds)


def test_matrices_compose():
    rng = random.Random(0)
    for _ in range(50):
        kinds = bytes(rng.randrange(4) for _ in range(30))
        cut = rng.randrange(1, 29)
        a, b = chat.matrix(kinds[:cut]), chat.matrix(kinds[cut:])
        both = (a[:, :, None] + b[None]).min(axis=1).clip(max=chat.NEVER)
        assert (both == chat.matrix(kinds)).all()


def turns():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", " User ", "tool", None, "ASSISTANT"]
    rows = [(7, k, rng.choice(roles[:3]), f"long {k}") for k in range(900)]  # one conversation in most ranges
    for c in range(60):
        rows += [(100 + c, k, rng.choice(roles), rng.choice([None, "", f"text {c} {k}"])) for k in range(rng.randrange(1, 9))]
    rows += [(100, 1, "user", "tie"), (100, 1, "assistant", "tie"), (100, 1, "user", "tie"), (100, None, "user", "first")]
    rows += [(None, 0, "assistant", "none")] + [(9, 0, "user", "again")] * 40
    return rows


@pytest.mark.parametrize("parts", [1, 13])
def test_rendering(session, parts):
    rows = turns()
    table = session.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")
    before = session.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = chat.format_turns(table).collect()
    finally:
        session.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [-1 if r.turn is None else r.turn for r in own] == sorted(-1 if r.turn is None else r.turn for r in own)
        kinds = bytes(KIND.get((r.role or "").strip().lower(), 3) for r in own)
        states = chat.solve(kinds)
        assert [chat.ROLES.index(r.new_role) + 1 for r in own] == list(states[1:]), conv
        messages = []  # (role, text) of the repaired conversation, made message by message
        n_inserted = 0
        numbers = []
        for r, s, t in zip(own, states, states[1:]):
            text = next(x[3] or "" for x in rows if x[:3] == (conv, r.turn, r.role) and (x[3] or "") in r.piece)
            _, action, inserted = chat._step(s, t)
            messages += [(x, "") for x in inserted]
            n_inserted += len(inserted)
            if action == "merge":
                messages[-1] = (messages[-1][0], None)
            else:
                messages.append((chat.ROLES[t - 1], text))
            numbers.append(len(messages) - 1)
        messages += [(x, "") for x in chat.END[states[-1]]]
        n_inserted += len(chat.END[states[-1]])
        assert [r.message for r in own] == numbers and sum(r.inserted for r in own) == n_inserted
        whole = "".join(r.piece for r in own)
        assert [x.split("\n")[0] for x in whole.split("<|im_start|>")[1:]] == [m for m, _ in messages]
        assert whole.count("<|im_end|>\n") == len(messages) and whole.endswith("<|im_end|>\n")
        said = [m for m, _ in messages if m != "system"]
        assert said == ["user", "assistant"] * (len(said) // 2) and "system" not in [m for m, _ in messages[1:]]


def test_empty_table(session):
    none = session.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(none).collect() == []
