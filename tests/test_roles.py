"""Changes of roles in order, against a plain replay."""

from __future__ import annotations

import random

from cairn.operators import publish as op


def replay(profiles, changes):
    roles, out = dict(profiles), []
    for i, actor, user, role in sorted(changes):
        if user not in roles:
            verdict = "refused: no such user"
        elif actor == user:
            verdict = "refused: own role"
        elif roles.get(actor) != "admin":
            verdict = "refused: not an administrator"
        elif role not in op.ROLES:
            verdict = "refused: no such role"
        else:
            verdict, roles[user] = "changed", role
        out.append((i, user, verdict, roles.get(user)))
    return out


def test_replay(spark):
    rng = random.Random(5)
    profiles = [(i, "admin" if i < 3 else "user") for i in range(25)]
    changes = [(i, rng.randrange(27), rng.randrange(27), rng.choice(("admin", "admin", "user", "editor", "owner"))) for i in range(300)]
    profile, change = "user_id long, role string", "change_id long, actor_id long, user_id long, role string"
    got = op.replay_roles(spark.createDataFrame(profiles, profile), spark.createDataFrame(changes, change))
    want = replay(profiles, changes)
    assert sorted(map(tuple, got.collect())) == want and {v for _, _, v, _ in want} == {"changed", "refused: no such user", "refused: own role", "refused: not an administrator", "refused: no such role"}
    gone = [(0, 0, 1, "user"), (1, 1, 2, "user"), (2, 0, 1, "admin"), (3, 1, 0, "user"), (4, 0, 2, "user")]  # 1 can't act while it is no administrator, nor 0 at the end
    got = op.replay_roles(spark.createDataFrame(profiles, profile), spark.createDataFrame(gone, change))
    assert sorted(map(tuple, got.collect())) == replay(profiles, gone)


def test_replay_in_cells(spark, monkeypatch):
    """Changes are walked in cells of equal size, whoever makes them: one actor makes most, one user meets most."""
    monkeypatch.setattr(op, "CHANGES_AT_ONCE", 7)
    rng = random.Random(6)
    profiles = [(i, "admin" if i < 2 else "user") for i in range(40)]
    one = lambda often: often if rng.random() < 0.7 else rng.randrange(41)
    changes = [(3 * i, one(0), one(39), rng.choice(("admin", "user", "editor", "owner"))) for i in range(200)]
    got = op.replay_roles(spark.createDataFrame(profiles, "user_id long, role string"), spark.createDataFrame(changes, "change_id long, actor_id long, user_id long, role string"))
    assert sorted(map(tuple, got.collect())) == replay(profiles, changes)
