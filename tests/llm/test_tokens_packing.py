import random
from collections import Counter
from pathlib import Path

import pytest

from leafwork.llm import tokens
from leafwork.llm.packing import Bins, cluster_bits, pack, pack_documents, room_left, source_bits

HERE = Path(tokens.rank_file("byte_bpe_50k"))
needs_files = pytest.mark.skipif(not HERE.exists(), reason="no public vocabulary files here")
TEXTS = ["", None, " ", "Hello  world, it's 2024!\n\n\tyes", "سلام دنیا، می‌روم", "日本語。テスト", "😀 café ﬁn <|endoftext|>", "a" * 5000, "x   y​", "\u0000\u0007 control", "the the the"]


@needs_files
def test_ids_equal_public_libraries():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, HERE.read_bytes().splitlines())}
    tik = tiktoken.Encoding("own", pat_str=tokens.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(str(HERE.with_suffix(".json")))
    other.encode_special_tokens = True
    enc = tokens.encoder(str(HERE))
    random.seed(0)
    more = ["".join(random.choice("ab 1'é…و‌私\n") for _ in range(random.randrange(200))) for _ in range(200)]
    for t in [t for t in TEXTS if t is not None] + more:
        ids = enc.encode(t)
        assert ids == tik.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids
        assert enc.decode(ids) == t and enc.count(t) == len(ids)


@needs_files
def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    enc = tokens.Encoder(str(HERE))
    text = " ".join(f"w{i}" for i in range(50))
    assert enc.decode(enc.encode(text)) == text and enc.count(text) == len(enc.encode(text))


@needs_files
def test_ids_of_documents(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)] + [(1, None)]).selectExpr("*", "'x' AS ids", "1 AS cluster", "2 AS n_tokens")
    got = tokens.encode_documents(docs)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(TEXTS) + 1
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[0] == [] and by[1] == [] and len(by[3]) > 5
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {k: len(v) for k, v in by.items()}
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def test_rank_files_must_be_whole(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        tokens.read_ranks(tmp_path / "r")


def brute(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and not (b["s"] & source or b["c"] & cluster)]
        if fits:
            room = min(r for r, _ in fits)
            k = next(k for r, k in fits if r == room)
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": 0, "c": 0})
        b = bins[k]
        b["room"] -= size
        b["s"] |= source
        b["c"] |= cluster
        out.append(k)
    return out, bins


def test_search_is_that_of_every_bin():
    random.seed(2)
    for _ in range(30):
        items = sorted(((random.randrange(1, 60), 1 << random.randrange(4), random.choice([0, 1, 2])) for _ in range(120)), reverse=True)
        got = pack([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100)
        assert got == brute(items, 100)[0]


def test_conflicts_are_never_relaxed():
    bins = Bins(10)
    assert [bins.put(5, 1, 0) for _ in range(4)] == [0, 1, 2, 3]
    assert [bins.put(5, 2, 0) for _ in range(2)] == [0, 1]
    b = Bins(10)
    assert [b.put(5, 0, 1) for _ in range(3)] == [0, 1, 2]


def test_a_source_shares_containers_only_by_the_pigeonhole():
    # 9 of 12 items of one source for 4 containers: three to a container are the least
    bits = source_bits(["hot"] * 9 + ["a", None, "a"], 4)
    assert len(set(bits[:9])) == 3 and max(bits[:9].count(b) for b in set(bits[:9])) == 3
    assert bits[9] == bits[11] and bits[9] not in bits[:9] and bits[10] == 0
    assert source_bits(["a"] * 4, 4) == [1] * 4 and source_bits([], 1) == []
    assert cluster_bits([7, 8, 7, 9]) == [1, 0, 1, 0]


@needs_files
def test_pack_documents(spark, make_docs):
    random.seed(3)
    docs = [(i, " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(random.randrange(1, 60))), f"s{i % 3}" if i % 2 else None) for i in range(300)]
    docs += [(1000 + i, "same copied words here", "hot") for i in range(20)] + [(2000, "", "a"), (2001, None, "a"), (2002, "long " * 500, "a")]
    sizes = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 512)], "pack_id int, tokenizer string, capacity int")
    df = make_docs(docs)
    got = pack_documents(df, sizes, shard_items=100).collect()
    counts = {r.doc_id: (r.n_tokens, r.cluster) for r in tokens.count_tokens(df).collect()}
    source = {d[0]: d[2] for d in docs}
    shards = {}
    for r in got:
        if r.container is not None and r.container.split("-")[1] != "doc":
            shards.setdefault(({1: 64, 2: 512}[r.pack_id], r.container.split("-")[1]), []).append(r)
    most = {k: max(-(-n // -(-sum(r.n_tokens for r in v) // k[0])) for n in Counter(source[r.doc_id] for r in v if source[r.doc_id]).values()) for k, v in shards.items()}
    for pack_id, capacity in ((1, 64), (2, 512)):
        own = [r for r in got if r.pack_id == pack_id]
        assert sum(r.n_tokens for r in own) == sum(n for n, _ in counts.values())
        assert {r.doc_id for r in own} == set(counts)
        bins = {}
        for r in own:
            if r.container is not None:
                bins.setdefault(r.container, []).append(r)
            else:
                assert r.n_tokens == 0
        for held in bins.values():
            assert sum(r.n_tokens for r in held) <= capacity
            clusters = [counts[r.doc_id][1] for r in held]
            assert len(clusters) == len(set(clusters))
            # 150 texts of three sources and 150 without one: no container holds more of a source than the pigeonhole asks for
            texts = [source[r.doc_id] for r in held if not r.container.split("-")[1] == "doc" and source[r.doc_id]]
            assert not texts or max(texts.count(s) for s in set(texts)) <= most[capacity, held[0].container.split("-")[1]]
        for doc, (n, _) in counts.items():
            parts = [r for r in own if r.doc_id == doc]
            assert len(parts) == max(1, -(-n // capacity)) and len({r.part_no for r in parts}) == len(parts)
    assert pack_documents(df.limit(0), sizes).count() == 0 and pack_documents(df, sizes.limit(0)).count() == 0
    # the copies need a container each; without them hardly any room is left
    few = df.filter("source IS NULL OR source <> 'hot'")
    assert all(r.unused < 0.2 for r in room_left(pack_documents(few, sizes), sizes).collect())
