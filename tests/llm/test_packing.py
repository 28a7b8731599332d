import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.packing import Limits, Packer, pack_documents
from tallyloom.llm.tokens import WordTokenizer, tokenizer_path

TEXTS = [None, "", "a", "Hello, WORLD!  it's 12", "a<|endoftext|>b c", "Σας ΟΔΟΣ é x　y\x1cz\x85q", "w" * 5000, "e ́ don't", "l'ÉTÉ, Ünïcode!! (Ω) ΤΕΛΟΣ? ПРИВЕТ... İstanbul. K\u212a ǅ ﬁn 中文。 it's, a-b--c; x<|endoftext|>, 2024.", " ".join(f"word{i}" for i in range(9000))]


def plain(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_word_memory_gives_the_tokenizers_ids(monkeypatch):
    import tallyloom.llm.tokens as T

    end = np.array([2], "<u4").tobytes()
    want = [np.array(ids, "<u4").tobytes() for ids in plain(TEXTS)]
    for remembered in (400_000, 50):
        monkeypatch.setattr(T, "REMEMBERED", remembered)
        monkeypatch.setattr(T, "STEMS", remembered)
        monkeypatch.setattr(T, "BYTES", 40)
        assert list(WordTokenizer(tokenizer_path()).encode_all(pa.array(TEXTS), end)) == want
        assert WordTokenizer(tokenizer_path()).counts(pa.array(TEXTS[3:])).tolist() == [len(w) // 4 - 1 for w in want[3:]]


def sequences(pieces):
    out = defaultdict(list)
    for p in pieces:
        out[p["sequence_id"]].append(p)
    return out


def test_each_id_is_in_one_piece_and_nothing_is_padded(spark, documents):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(100 + i, "some words " * (i % 90), "s") for i in range(400)] + [(None, "x", "s"), (0, None, "s")]
    got = pack_documents(documents(rows)).collect()
    want = dict(zip((r[0] for r in rows), plain([r[1] for r in rows]), strict=True))
    ids = defaultdict(list)
    for p in sorted(got, key=lambda p: p["start"]):
        ids[p["doc_id"]].append(p)
        part = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids"] == np.array(part, "<u4").tobytes() and p["doc_tokens"] == len(want[p["doc_id"]])
        assert zlib.crc32(p["ids"]) == zlib.crc32(np.array(part, "<u4").tobytes())
    for doc_id, pieces in ids.items():
        copies = sum(r[0] == doc_id for r in rows)
        assert sum(p["length"] for p in pieces) == copies * len(want[doc_id])
    for pieces in sequences(got).values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    by_row = defaultdict(list)
    for p in got:
        by_row[p["example_id"]].append(p)
    assert len(by_row) == len(rows)
    for pieces in by_row.values():
        assert len({p["doc_id"] for p in pieces}) == 1
        assert sorted(i for p in pieces for i in range(p["start"], p["start"] + p["length"])) == list(range(pieces[0]["doc_tokens"]))


def test_small_chunks_and_empty(documents):
    docs = documents([(i, "one two three " * 200, "s") for i in range(60)])
    got = pack_documents(docs, chunk=2000).collect()
    assert sum(p["length"] for p in got) == 60 * 601
    short = [n for s in sequences(got).values() if (n := sum(p["length"] for p in s)) < 6 * 601]
    assert all(n & (n - 1) == 0 for n in short)  # the ends of the two tasks
    assert pack_documents(docs.filter("doc_id = -1")).count() == 0


def test_little_is_padded(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.lognormal(5.5, 1.2, 6000))]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("sequence_id", "length", "start", "doc_tokens").collect()
    lengths = [sum(p["length"] for p in s) for s in sequences(got).values()]
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in lengths)
    assert padded <= 1.002 * sum(lengths)
    cut = {p["start"] for p in got if p["length"] < p["doc_tokens"] <= 4096}
    assert len(cut) <= 13  # in the task's last sequence alone


@pytest.mark.parametrize("limits", [Limits(64, 3, 20), Limits(64, 2, 64), Limits(16, 1, 5), Limits(128, 8, 128)])
def test_all_limits_hold_at_once(limits):
    rng = np.random.default_rng(1)
    packer, rows, total = Packer(limits, 0), [], 0
    for i in range(300):
        n, loss_from = int(rng.integers(1, 200)), int(rng.integers(0, 150))
        total += n
        rows += packer.add(i, n, loss_from)
        if i % 50 == 49:
            rows += packer.pack()
    rows += packer.pack() + packer.tail()
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    assert sum(r[2] for r in rows) == total
    for s in by.values():
        assert sum(r[2] for r in s) <= limits.tokens and len(s) <= limits.segments and sum(r[5] for r in s) <= limits.loss


def first_fit(sizes, limits):
    """Bins of a plain first fit in the order of arrival, under all three limits."""
    rooms = []
    for n, loss in sizes:
        for room in rooms:
            if room[0] >= n and room[1] >= 1 and room[2] >= loss:
                break
        else:
            rooms.append(room := [limits.tokens, limits.segments, limits.loss])
        room[0], room[1], room[2] = room[0] - n, room[1] - 1, room[2] - loss
    return len(rooms)


#: Instruction data: kinds of examples as (prompt tokens, answer tokens), and limits.
MIXES = [
    ([(900, 100), (150, 500), (20, 15)], Limits(2048, 12, 1024)),
    ([(900, 100), (150, 500), (20, 15), (20, 15), (20, 15)], Limits(2048, 8, 1024)),
    ([(400, 60), (100, 200), (20, 15), (30, 15), (20, 35)], Limits(2048, 10, 600)),
]


@pytest.mark.parametrize("mix", range(len(MIXES)))
def test_dot_product_beats_first_fit_where_three_limits_bind(mix):
    kinds, limits = MIXES[mix]
    rng = np.random.default_rng(9)
    drawn = [kinds[i] for i in rng.integers(0, len(kinds), 2000)]
    sizes = [(int(rng.integers(p // 2, 2 * p)) + 1, min(limits.loss, int(rng.integers(q // 2, 2 * q)))) for p, q in drawn]
    sizes = [(min(limits.tokens, n + loss), loss) for n, loss in sizes]
    packer, rows = Packer(limits, 0), []
    for i, (n, loss) in enumerate(sizes):
        rows += packer.add(i, n, n - loss)
    rows += packer.pack() + packer.close()
    used = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        used[r[3]] = [used[r[3]][0] + r[2], used[r[3]][1] + 1, used[r[3]][2] + r[5]]
    assert len(rows) == len(sizes)  # every example is whole
    bound = max(-(-sum(n for n, _ in sizes) // limits.tokens), -(-len(sizes) // limits.segments), -(-sum(loss for _, loss in sizes) // limits.loss))
    assert bound <= len(used) <= 1.08 * bound and len(used) < first_fit(sizes, limits)

    most = [max(u[i] for u in used.values()) for i in range(3)]
    assert most[0] > 0.99 * limits.tokens and most[2] > 0.99 * limits.loss and (mix == 0 or most[1] == limits.segments)  # they bind



def test_dot_product_fills_sequences():
    packer, rows = Packer(Limits(100, 50, 100), 0), []
    for i, n in enumerate([60, 40, 70, 30, 55, 45, 80, 20] * 5):
        rows += packer.add(i, n, 0)
    rows += packer.pack() + packer.close()
    assert len({r[3] for r in rows}) == 20 and len(rows) == 40
