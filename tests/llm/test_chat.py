import random

import pytest

from tidewire.llm.chat import format_chats


def brute(rows):
    """{conv: (turns, snapshots, text)} of rows (conv, turn, role, text) by comparing whole lists."""
    chats = {}
    key = lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r[1:])
    for conv in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        chats[conv] = [(r[2], r[3]) for r in mine]
    out = {}
    for conv, chat in chats.items():
        longer = any(len(o) > len(chat) and o[: len(chat)] == chat for o in chats.values())
        same = [c for c, o in chats.items() if o == chat]
        if not longer and conv == min(same):
            text = "".join(f"<|im_start|>{r or 'user'}\n{t or ''}<|im_end|>\n" for r, t in chat)
            out[conv] = (len(chat), len(same), text)
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(rng.choice(["user", "assistant", None, "system"]), rng.choice(["hi", "", None, "ok", "é\nx"])) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 4)):
            upto = rng.randint(1, len(turns))
            rows += [(conv, 3 * k, r, t) for k, (r, t) in enumerate(turns[:upto])]
            conv += 1
    rows += [(900, None, "user", "hi"), (900, 1, "user", "a"), (900, 1, "user", "a"), (901, -5, "user", "hi")]
    rows += [(None, 0, "user", "lost"), (902, 7, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("tidewire.llm.chat.BLOCK", block)
    rows = rows_of()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got, facts = {}, {}
    for r in sorted(format_chats(table.repartition(3)).collect(), key=lambda r: (r["conv_id"], r["part"])):
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["rendered"]
        facts[r["conv_id"]] = r["n_turns"], r["n_snapshots"]
    assert {c: (*facts[c], got[c]) for c in got} == brute(rows)


def test_a_long_conversation_has_parts(spark, monkeypatch):
    monkeypatch.setattr("tidewire.llm.chat.BLOCK", 10)
    rows = [(1, k, "user", str(k)) for k in range(35)] + [(2, k, "user", str(k)) for k in range(34)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chats(table).collect()
    assert sorted((r["conv_id"], r["part"], r["n_turns"]) for r in got) == [(1, p, 35) for p in range(4)]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(table).count() == 0


def test_long_conversation_equals_sql(spark, tmp_path):
    """The SQL of the query and the operator cut at the same turns."""
    import oracle
    from tidewire.llm.queries import ORACLES, QUERIES

    rows = [(1, t, "user", f"t{t}") for t in range(1025)] + [(2, 0, "user", "t0"), (3, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = QUERIES["op5_chat"](spark, str(tmp_path))
    assert oracle.difference(df, con, ORACLES["op5_chat"]) is None and df.count() == 3
