import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plansheet.llm import materialise as M
from plansheet.llm.packing import pack, plan
from plansheet.llm.tokens import encoder, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "text string, doc_id long, part int, ids string"


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_librarys(texts):
    slow = Tokenizer.from_file(PATH)
    for t, got in zip(texts, encoder(vocabulary(PATH))(texts), strict=True):
        assert got.tolist() == slow.encode(t, add_special_tokens=False).ids


def test_strings_of_special_tokens_are_those_tokens():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", " <|endoftext|>\n"]
    slow = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in encoder(vocabulary(PATH))(texts)] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_run_in_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(vocabulary(path))(["Some words here"])[0].tolist() == Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=300, deadline=None)
def test_plan_places_every_rank_once_and_never_overfills(lengths):
    slots, n = plan(Counter(lengths), 64)
    ranks, cells = defaultdict(list), set()
    for length, rank, times, first, at in slots:
        ranks[length] += range(rank, rank + times)
        for s in range(first, first + times):
            new = {(s, at + i) for i in range(length)}
            assert not cells & new and s < n
            cells |= new
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in Counter(lengths).items()}
    for s in {s for s, _ in cells}:
        assert max(i for x, i in cells if x == s) + 1 == sum(x == s for x, _ in cells) <= 64
    assert len({s for s, _ in cells}) == n
    best = -(-sum(lengths) // 64)
    assert n <= max(best, 1.3 * best + 1)


def test_exact_complements_are_used():
    assert plan({60: 10, 4: 10}, 64)[1] == 10
    assert plan({32: 6, 20: 3, 12: 9}, 64)[1] == 6
    assert plan({40: 2, 10: 2, 9: 2, 5: 2}, 64)[1] == 2


def test_pack(spark):
    rows = [(None, 0), ("", 1), ("word " * 300, 2), ("xyz abc " * 2000, 3), ("tie", 4), ("tie", 4), ("n", None)] + [(f"text {i} " * (i % 37), 10 + i) for i in range(200)]
    df = spark.createDataFrame([(t, i, 5, "z") for t, i in rows], SCHEMA).repartition(3)
    got = pack(df, PATH, capacity=256, keep_ids=True).collect()
    ids = {i: [*encoder(vocabulary(PATH))([t or ""])[0].tolist(), 0] for t, i in rows}
    docs, filled = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
        part = np.frombuffer(r.ids, "<u4")
        assert part.tolist() == ids[r.doc_id][r.start : r.start + r.length] and zlib.crc32(r.ids) == r.ids_crc32
    assert set(docs) == {i for _, i in rows} and len(docs[4]) == 2
    for i, pieces in docs.items():
        if i != 4:
            pieces.sort(key=lambda r: r.piece)
            assert sum(r.length for r in pieces) == len(ids[i]) and [r.piece for r in pieces] == list(range(len(pieces)))
            assert all(r.length == 256 for r in pieces[1:])
    for x in filled.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_slots_are_a_permutation(n, key):
    s = M.slots(np.arange(n), n, key)
    assert sorted(s.tolist()) == list(range(n))
    assert (M.sequence_at(s, n, key) == np.arange(n)).all()


def test_materialise(spark, tmp_path):
    rows = [(None, 0), ("", 1), ("xyz abc " * 2000, 3), ("tie", 4), ("tie", 4), ("n", None)] + [(f"text {i} " * (i % 37), 10 + i) for i in range(100)]
    df = spark.createDataFrame([(t, i, 5, "z") for t, i in rows], SCHEMA).repartition(3)
    out = str(tmp_path / "shards")
    got = sorted(M.materialise(df, PATH, out, key=7, seq_len=64, shard_bytes=64 * 2 * 10).collect(), key=lambda r: r.slot)
    back = list(M.read_from(out))
    assert [r.slot for r in got] == list(range(len(got))) and len(back) == len(got)
    total = 0
    for r, ids in zip(got, back, strict=True):
        assert zlib.crc32(ids[: r.n_tokens].tobytes()) == r.crc32 and not ids[r.n_tokens :].any()
        assert r.shard == r.slot // 10 and r.byte_offset == r.slot % 10 * 128 and len(r.doc_ids) == len(r.doc_starts)
        total += r.n_tokens
    encode = encoder(vocabulary(PATH))
    assert total == sum(len(encode([t or ""])[0]) + 1 for t, _ in rows)
    assert [x.tolist() for x in M.read_from(out, 13)] == [x.tolist() for x in back[13:]]
    # a document's parts in sequence give its ids
    parts = sorted(((M.sequence_at(np.array([r.slot]), len(got), 7)[0], ids, r) for r, ids in zip(got, back, strict=True)), key=lambda x: x[0])
    text = []
    for _, ids, r in parts:
        for i, a, z in zip(r.doc_ids, r.doc_starts, [*r.doc_starts[1:], r.n_tokens], strict=True):
            if i == 3:
                text += ids[a:z].tolist()
    assert text == [*encode(["xyz abc " * 2000])[0].tolist(), 0]
    empty = str(tmp_path / "none")
    assert M.materialise(spark.createDataFrame([], SCHEMA), PATH, empty).collect() == [] and list(M.read_from(empty)) == []


def test_registered_queries_against_the_library(spark):
    """Pieces and ids of op2 and the tokens of op9, for all documents of a table, by the library itself."""
    from plansheet.llm import queries

    d = "/root/testdata/sf0.001"
    slow = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*slow.encode(r.text or "", add_special_tokens=False).ids, 0] for r in queries._docs(spark, d).collect()}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op2_best_fit_packing"](spark, d).collect():
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert {i: sum(r.length for r in rs) for i, rs in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert all(r.length == 2048 for rs in pieces.values() for r in rs if r.piece) and all(sorted(r.piece for r in rs) == list(range(-(-len(ids[i]) // 2048))) for i, rs in pieces.items())
    for x in filled.values():
        ends = [0, *np.cumsum([n for _, n in sorted(x)]).tolist()]
        assert [at for at, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048
    total = sum(map(len, ids.values()))
    assert len(filled) <= -(-total // 2048) * 1.02 + 1  # near the bound that no packing beats
    order = queries.QUERIES["op9_training_order"](spark, d).collect()
    assert sum(r.n_tokens for r in order) == total and sorted(r.slot for r in order) == list(range(len(order)))
