import random

import pyarrow as pa

from sitelens.llm import passages
from sitelens.llm.common import utf8


def prose(r, n):
    out = []
    while len(out) < n:
        s = [r.choice("bcdfgh") + r.choice("aeiou") + r.choice("lmnprst") + r.choice(["", "a", "er", "ing"]) + r.choice("xyz") for _ in range(r.randrange(3, 16))]
        s[-1] += r.choice([".", ".", "?", ".\n"])
        out += s
    return out[:n]


def test_tune():
    b, r = passages.tune(0.8)
    assert 1 - (1 - 0.8**r) ** b >= 0.98 and b <= 4


def test_paragraph_bounds():
    texts = ["a b c d e. f g h i j\nk l m n o p! q r", "", "one two", "x " * 100, "tail of five words here"]
    data, offs = utf8(pa.array(texts, pa.large_string()))
    u = passages.Units(data, offs)
    assert [(int(t), int(a), int(e - f)) for t, a, f, e in zip(u.text, u.at, u.first, u.stop)][:3] == [(0, 0, 5), (0, 5, 5), (0, 10, 6)]
    assert (u.text == 4).sum() == 1 and not (u.text == 2).any()


def test_planted_passages(spark):
    r = random.Random(4)
    docs = {d: prose(r, r.choice([20, 80, 200, 400])) for d in range(260)}
    planted = {}
    for p in range(12):
        passage = prose(r, 70)
        for d in r.sample(range(200), 4):
            at = r.randrange(len(docs[d]))
            docs[d] = docs[d][:at] + passage + docs[d][at:]
            planted.setdefault(p, set()).add(d)
    for d in range(300, 306):  # near copies of one text
        w = list(docs[210])
        w[5 + d % 7] = "changed"
        docs[d] = w
    rows = [(d, " ".join(w), "t", 1) for d, w in docs.items()] + [(400, None, "t", 1), (401, "", "t", 1), (None, "no id", "t", 1), (402, "short", "t", 1), (402, "short", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, start int")
    for size in (passages.GROUP, 2000):
        got = passages.repeated_runs(df, group_bytes=size).collect()
        ids = {x["doc_id"] for x in got}
        assert set().union(*planted.values()) <= ids
        assert {210, *range(300, 306)} <= ids if len(docs[210]) > 60 else True
        assert ids <= set().union(*planted.values()) | {210, *range(300, 306)}
        assert all(x["kept_by"] <= x["doc_id"] and x["stop"] - x["start"] >= 30 for x in got)
        for own in planted.values():
            assert any(not x["removed"] for x in got if x["doc_id"] == min(own))
    assert passages.repeated_runs(df.limit(0)).collect() == []


def test_large_components_lose_no_link(spark):
    r = random.Random(11)
    lines = []
    for f in range(60):  # families of near lines, each line in one document
        base = [f"f{f}w{i}" for i in range(29)]
        for v in range(12):
            w = list(base)
            for e in r.sample([0, 1, 27, 28], r.randrange(1, 4)):
                w[e] = f"e{r.randrange(4)}"
            lines.append((f, w))
    rows = [(d, " ".join(w), f) for d, (f, w) in enumerate(lines)]
    sets = [{tuple(w[i : i + 5]) for i in range(25)} for _, w in lines]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), i)
    want = sorted((i, least[find(i)]) for i in range(len(rows)))
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    for size in (passages.GROUP, 400):
        got = {x["doc_id"]: x["kept_by"] for x in passages.repeated_runs(df, min_words=20, group_bytes=size).collect()}
        assert sorted((i, got.get(i, i)) for i in range(len(rows))) == want


def test_equal_spans_inside_long_sentences(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(4))
    docs, planted = [], []
    for k in range(60):
        span = [word() for _ in range(51 + k % 10)]
        for _ in range(2):
            before, after = ([word() for _ in range(r.randrange(15, 40))] for _ in range(2))
            planted.append((len(docs), len(before), len(before) + len(span)))
            docs.append(" ".join(before + span + after) + ".")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {}
    for x in passages.repeated_runs(df).collect():
        got.setdefault(x["doc_id"], []).append((x["start"], x["stop"], x["n_words"], x["kept_by"]))
    assert all(len(got.get(d, [])) == 1 for d, _, _ in planted)
    for d, a, b in planted:
        start, stop, n, kept = got[d][0]
        assert start <= a + 10 and b - 10 <= stop and n == stop - start and kept == d // 2 * 2


def test_windows_depend_on_the_span_only():
    r = random.Random(13)
    texts = ["", "one two", " ".join(prose(r, 29)), " ".join(prose(r, 30)), *(" ".join(prose(r, n)) for n in (31, 40, 51, 200))]
    data, offs = utf8(pa.array(texts, pa.large_string()))
    w = passages.Units(data, offs).windows()
    for t, text in enumerate(texts):
        n = len(text.split())
        at = w.at[w.text == t]
        assert (len(at) > 0) == (n >= 30)
        if len(at):
            assert at[0] <= 10 and n - at[-1] - 20 <= 10 and all(at[1:] - at[:-1] <= 11)
        one = passages.Units(*utf8(pa.array([text], pa.large_string()))).windows()
        assert one.at.tolist() == at.tolist() and one.node.tolist() == w.node[w.text == t].tolist()


def test_short_sentences_join(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("BCDFGH") + r.choice("AEIOU") for _ in range(4))
    docs = []
    for _ in range(30):  # near copies, changed too often for windows
        w = [word() + r.choice(["", "", ".!!"]) for _ in range(160)]
        docs.append(" ".join(w))
        for i in range(9, 160, 18):
            w[i] = word()
        docs.append(" ".join(w))
    data, offs = utf8(pa.array(docs, pa.large_string()))
    u = passages.Units(data, offs)
    assert (u.stop - u.first).sum() > 0.8 * 160 * len(docs) and (u.stop - u.first >= 5).all()
    got = {x["doc_id"] for x in passages.repeated_runs(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert len(got) > 0.5 * len(docs)


def test_very_long_texts_and_ids_of_several_texts(spark):
    r = random.Random(21)
    long, span = prose(r, 220_000), prose(r, 70)
    assert len(" ".join(long)) > 1 << 20
    docs = [(1, " ".join(long[:150_000] + span + long[150_000:])), (2, " ".join(prose(r, 40) + span + prose(r, 40)))]
    # one doc_id with two texts: places of one are no places of the other
    one, two = prose(r, 60), prose(r, 60)
    docs += [(3, " ".join(one + prose(r, 60))), (3, " ".join(prose(r, 60) + two)), (4, " ".join(one)), (5, " ".join(two)), (6, " ".join(prose(r, 90))), (6, " ".join(prose(r, 90)))]
    got = [(x["doc_id"], x["start"], x["stop"], x["kept_by"]) for x in passages.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    by = {d: sorted(x[1:] for x in got if x[0] == d) for d in range(1, 7)}
    assert len(by[1]) == 1 and abs(by[1][0][0] - 150_000) <= 10 and abs(by[1][0][1] - 150_070) <= 10 and by[1][0][2] == 1
    assert len(by[2]) == 1 and by[2][0][2] == 1 and not by[6]
    assert len(by[3]) == 2 and by[3][0][0] <= 10 and by[3][1][0] >= 50 and len(by[4]) == len(by[5]) == 1


def test_groups_hold_each_paragraph_once(spark, monkeypatch):
    """A paragraph that a hundred tasks hold is one row of its group."""
    seen, table = {}, passages.table

    def watched(df, name):
        out = table(df, name)
        seen[name] = out[0]
        return out

    monkeypatch.setattr(passages, "table", watched)
    one, two = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    df = spark.createDataFrame([(k, f"{one}\n{two} {k % 2}") for k in range(400)], "doc_id long, text string").repartition(100)
    assert passages.repeated_runs(df).count() == 400
    sets = seen["sets"]
    assert sets.count() == sets.select("node").distinct().count() <= 40
