"""Chat formatting against the SQL and a plain version."""

import random

from compare import connect, differences

from fleetledger.llm import chat, queries


def test_query_matches_sql(spark, sf_small):
    found = queries.QUERIES["op4_chat_format"](spark, sf_small)
    assert differences(found, connect(sf_small), queries.ORACLE["op4_chat_format"]) == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain(rows):
    turns = {}
    for c, t, r, x in set(rows):
        turns.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    whole = {c: [(t[6], t[7]) for t in sorted(ts, key=lambda t: t[:6])] for c, ts in turns.items()}
    out = {}
    for c, ts in whole.items():
        if any(len(o) > len(ts) and o[: len(ts)] == ts for o in whole.values()):
            continue
        twins = [d for d, o in whole.items() if o == ts]
        if c == min((d for d in twins if d is not None), default=None):
            text = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in ts)
            out[c] = (len(ts), len(twins), text)
    return out


def collected(df, part_turns=1024):
    out = {}
    for r in sorted(chat.render(chat.maximal(df), part_turns).collect(), key=lambda r: (r.conv_id or 0, r.part)):
        n, m, text = out.get(r.conv_id, (r.n_turns, r.n_logged, ""))
        out[r.conv_id] = (n, m, text + r.text)
    return out


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat, "_BLOCK", 4)
    rng = random.Random(1)
    rows = []
    for c in range(60):
        base = [("user" if i % 2 == 0 else "assistant", f"{rng.randint(0, 1)}") for i in range(rng.randint(1, 6))]
        rows += [(c, i * 3, r, t) for i, (r, t) in enumerate(base)]
    long = [("user", str(i)) for i in range(40)]
    rows += [(100, i, r, t) for i, (r, t) in enumerate(long)] + [(101, i + 5, r, t) for i, (r, t) in enumerate(long[:21])]
    rows += [(None, 0, "user", "n"), (102, None, None, None), (102, 1, "user", ""), (103, 1, "user", None), (103, 1, "user", None), (104, 1, "b", "x"), (104, 1, "a", "y")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int").repartition(6)
    want = plain(rows)
    assert collected(frame) == want
    assert collected(frame, part_turns=3) == want
    assert 101 not in want and 100 in want and None in want


def test_empty(spark, rows):
    empty = rows([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.render(chat.maximal(empty)).collect() == []
