import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitelens.llm import packing

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TABLE = packing.WordTable(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, want, capacity):
    """want: list of (doc_id, ids). Every id in exactly one piece, sequences gapless and full or of a power of two."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    have = sorted((d, b"".join(bytes(r["ids"]) for r in sorted(own, key=lambda r: r["start"]))) for d, own in docs.items())
    assert have == sorted((d, np.array(x, "<u4").tobytes()) for d, x in want)
    for own in docs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == sum(x["length"] for x in own)
            at += r["length"]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 3), max_size=8), st.integers(0, 100))
def test_fill_is_best(counts, room):
    got = packing.fill(counts, room)
    sums = {0}
    for x, k in counts.items():
        sums = {s + j * x for s in sums for j in range(k + 1)}
    assert sum(x * k for x, k in got.items()) == max(s for s in sums if s <= room)
    assert all(k <= counts[x] for x, k in got.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "It's", "ΣΑΣ", "é", "́", "\x1c", " ", " ", "\n", " ", "12,5", "İ", "ǅ", "<|END", "a\x85b"]), max_size=8))
def test_words_are_encoded_as_whole_texts_are(text, parts):
    table = TABLE
    for t in (text, "".join(parts), text.join(parts)):
        assert table.encode([t])[0].tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_packer_small_capacity():
    rng = np.random.default_rng(1)
    for capacity in (4, 16, 64):
        p = packing.Packer(capacity, 5)
        want = [(d, rng.integers(0, 99, rng.integers(1, 3 * capacity)).tolist()) for d in range(3000)]
        for d, x in want:
            p.add(d, np.array(x, np.uint32))
        p.finish()
        names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
        rows = [dict(zip(names, x, strict=True)) | {"length": len(x[2])} for x in p.out]
        check([r | {"ids": r["ids"].astype("<u4").tobytes()} for r in rows], want, capacity)


def test_frames(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "Hello  world", 2), (4, "a " * 9000, 3)], "doc_id long, text string, start int")
    want = [(d, TOK.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in ((1, None), (2, ""), (3, "Hello  world"), (4, "a " * 9000))]
    check(packing.pack(docs).collect(), want, 4096)
    assert packing.pack(docs.limit(0)).collect() == []
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(r["doc_id"], TOK.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in real.collect()]
    check(packing.pack(real).collect(), want, 4096)
    ids = dict(want)
    for r in packing.op1_pack(spark, sf_dir).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
