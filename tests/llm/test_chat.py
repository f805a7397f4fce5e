import hashlib
import random

import pytest

from sitelens.llm import chat


def test_round_trip_of_hostile_turns(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "\\", "\\\\<|", "<<SYS>> a <</SYS>>", "<\\s>", "", "é\n\n", "[\\INST]", "<s>" * 50]
    rows = [(1, 0, "system", "be <|end|> kind")]
    rows += [(1, k + 1, "assistant" if k % 2 else "user", nasty[k % len(nasty)] + " word" * (k * 7 % 90)) for k in range(400)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, None, "ro<|says|>le", "x"), (3, None, "ro<|says|>le", "x"), (4, 0, "assistant", "long " * 5000), (None, 1, "user", "no id")]
    df = spark.createDataFrame([(*r, "u") for r in rows], "conv_id long, turn long, role string, text string, window string")
    w = chat.format_windows(df)
    back = w.join(chat.read_windows(w).withColumnRenamed("conv_id", "c2").withColumnRenamed("window", "w2"), [chat.F.col("conv_id").eqNullSafe(chat.F.col("c2")), chat.F.col("window") == chat.F.col("w2")]).orderBy("conv_id", "window").collect()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        mine = [r for r in back if r["conv_id"] == conv]
        assert [(t["role"], t["text"]) for r in mine for t in r["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert "".join(r["loss_text"] for r in mine) == "".join(r[3] or "" for r in own if r[2] == "assistant")
    first = [r for r in back if r["conv_id"] == 1]
    assert len(first) > 5 and all(r["n_tokens"] <= 1024 for r in first)
    assert all(r["formatted"].startswith("<|again|>system") for r in first[1:]) and any(r["formatted"].count("<|again|>") > 1 for r in first)
    assert chat.format_windows(df.limit(0)).collect() == []


def test_query_digests(spark, sf_dir):
    got = {r["conv_id"]: r for r in chat.op2_chat_format(spark, sf_dir).collect()}
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == 21
    for conv in {t["conv_id"] for t in turns}:
        own = [t for t in turns if t["conv_id"] == conv]
        said = "".join(f"{t['role']}\n{t['text'] or ''}\n" for t in own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        loss = "".join(t["text"] or "" for t in own if t["role"] == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("block", [4, 4096])
def test_windows_keep_the_budget(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "_BLOCK", block)
    r = random.Random(7)
    rows = []
    for c in range(60):
        system = c % 3 == 0
        for k in range(r.randrange(1, 700) if c < 3 else r.randrange(1, 30)):
            n = r.choice([0, 3, 40, 440, 900, 1019, 1500]) if r.random() < 0.5 else r.randrange(0, 300)
            rows.append((c, k, "system" if system and k == 0 else r.choice(["user", "assistant"]), "w " * (30 if system and k == 0 else n)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for x in chat.format_windows(df).collect():
        got.setdefault(x["conv_id"], []).append((x["window"], x["n_tokens"]))
    tok = lambda x: x[3].count("w") + 4
    over = 0
    for c in range(60):
        own = [x for x in rows if x[0] == c]
        head = tok(own[0]) if own[0][2] == "system" else 0
        want, at, open_, first = [0], 0, 0, True
        for x in own:
            room = 1024 if open_ == 0 else 1024 - 128 - head
            if at > open_ and (at + tok(x) - open_ > room):
                open_ = at
                want.append(at)
            at += tok(x)
        assert sorted(w for w, _ in got[c]) == want
        starts = sorted((w, n) for w, n in got[c])
        for (w, n), end in zip(starts, [*want[1:], at]):
            single = any(tok(x) == end - w for x in own)
            assert n <= 1024 or (single and end - w + head > 1024)
            over += n > 1024
    assert over and len(got) == 60


def test_turn_numbers_only_order(spark):
    """Sparse numbers, and ten thousand turns, give the windows that counting from 0 does."""
    turns = [(k % 7 * 13 + k % 3) for k in range(10_000)]
    rows = [(c, k * (1, 4096, 100_000)[c], "user" if k % 2 else "assistant", "w " * n) for c in range(3) for k, n in enumerate(turns[: (10_000, 300, 300)[c]])]
    rows += [(3, k, *r[2:]) for k, r in enumerate(x for x in rows if x[0] == 1)]
    got = {}
    for x in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "window", "n_tokens").collect():
        got.setdefault(x["conv_id"], set()).add((x["window"], x["n_tokens"]))
    assert got[1] == got[2] == got[3] and max(n for _, n in got[0]) <= 1024
    at, want = 0, [0]
    for n in turns:
        if at + n + 4 - want[-1] > (1024 if want[-1] == 0 else 896):
            want.append(at)
        at += n + 4
    assert sorted(w for w, _ in got[0]) == want
