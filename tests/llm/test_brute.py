"""The text operators against brute force, exact round trips and planted cases."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, chat, common, langid, licenses, multi_index, packing, ring, simhash, topk, toxicity
from pulsegrid.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts, **more):
    return [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]


ODD = [None, "", " \n\t", "a", "!!", "the the the", "x" * 30_000, "word " * 4_000, "é ñ 漢字 🙂", "same text here", "same text here", "Ａ<|endoftext|>b"]


#: Every column name that an operator makes or returns, and some by which others know a column.
CLASHES = [
    *("_none _id _hash row doc part no_id id no_source cluster near size n copy range bin piece begin length".split()),
    *("cell spot rank arc low high skip slot shard start times nth fp text_hash root component_id fingerprint least".split()),
    *("toxic_score toxic score lang_pred lang_score lang_spans _lang result result_ n_tokens ids_sha256 decoded_sha256 ids decoded _bpe".split()),
    *("dir th up license own_license cosine found_in from_license said n_words term at held hash".split()),
]


def clashing(df, names=CLASHES):
    return df.withColumns({c: F.lit(f"mine {c}") for c in names if c not in df.columns})


@pytest.fixture(scope="module")
def plain(spark):
    """Odd texts, a null id, a repeated row, null language and source."""
    return spark.createDataFrame(doc_rows(ODD) + [(None, "no id", None, None, None), (3, "a", "en", "s", 1)], DOC).withColumn("path", F.col("doc_id").cast("string"))


@pytest.fixture(scope="module")
def odd(plain):
    """The same rows with columns whose names clash with results and with what operators need between."""
    return clashing(plain)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_parts_are_whole_and_bounded():
    from pulsegrid.llm.textcode import parts

    texts = ["a" * n for n in (5, 0, 30, 4, 4, 4, 1, 1, 1, 1)] + [None]
    got = list(parts(texts, 3, 10))
    assert [t for p in got for t in p] == texts and all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in got)
    assert list(parts([], 3, 10)) == []


# the shared folder


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace as N

    def session(master, setting=None, dir_=None):
        return N(conf=N(get=lambda k, d=None: setting), sparkContext=N(master=master, getConf=lambda: N(get=lambda k: None), getCheckpointDir=lambda: dir_))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(session("spark://host:7077"))
    one = session("local[2]")
    assert common.shared_folder(one).startswith("file://") and common.shared_folder(one) == common.shared_folder(one)
    assert common.shared_folder(session("yarn", "hdfs://a/b")) == "hdfs://a/b" and common.shared_folder(session("yarn", None, "hdfs://c")) == "hdfs://c"


def test_former_tables_are_removed(spark, tmp_path, monkeypatch):
    """What a run leaves in the shared folder: no round of the labels but the last, no edges; the session's settings are as before."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(common, "shared_folder", lambda s: f"file://{tmp_path}")
    fps = [0]
    for k in range(15):
        fps.append(fps[-1] | 0b1111 << (4 * k))
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps)))
    left = lambda: sorted(p.name for p in tmp_path.glob("pulsegrid/*/*/*"))
    assert got.count() == len(fps) and left() == ["label"]
    simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert left() == ["by_fp", "fingerprints", "label", "label"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


# clashing names


def told(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize(
    ("run", "results"),
    [
        (lambda d: packing.best_fit_pack(d, 1000), ["doc_id", "piece", "begin", "length", "bin_group", "bin", "offset"]),
        (lambda d: ring.bounded_ring(d, 4), ["doc_id", "size", "text_crc32", "shard", "slot"]),
        (lambda d: toxicity.score_toxicity(d, toxicity.train(["bad word", "good word"] * 30, np.arange(60) % 2 == 0, ["en"] * 60)), ["doc_id", "text", "toxic_score", "toxic"]),
        (lambda d: langid.detect_languages(d, langid.fit(["the word of the day", "das Wort des Tages"], ["en", "de"])), ["doc_id", "text", "lang_pred", "lang_score", "lang_spans"]),
        (lambda d: bpe.tokenize(d, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")), ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]),
        (lambda d: licenses.scan_licenses(d.withColumn("text", F.concat(F.lit("Released under the MIT License. "), "text"))), ["doc_id", "path", "own_license", "cosine", "license", "found_in"]),
        (simhash.near_duplicates, ["doc_id", "fingerprint", "component_id"]),
        (simhash.one_of_each, ["doc_id", "text", "source"]),
    ],
    ids=["packing", "ring", "toxicity", "language", "bpe", "licenses", "near", "one_of_each"],
)
def test_clashing_names_change_nothing(plain, odd, run, results):
    """Values are the same with and without clashing columns, and columns that no result replaces keep theirs."""
    got = run(odd)
    assert told(got, results) == told(run(plain), results)
    mine = [c for c in CLASHES if c in got.columns and c not in results]
    if set(got.columns) > set(CLASHES) - set(results):
        row = got.select(*mine).first()
        assert all(row[c] == f"mine {c}" for c in mine) and len(mine) > 30


def test_clashing_names_of_turns_and_vectors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    names = ["segments", "formatted", "state", "turns", "n_turns", "valid", "i", "loss"]
    assert told(chat.format_chats(clashing(turns, names)), ["conv_id", "formatted", "valid"]) == told(chat.format_chats(turns), ["conv_id", "formatted", "valid"])
    rows = vectors_of(spark, odd_vectors())
    names = ["v", "h", "n", "r", "cid", "q", "ids", "need", "asked", "own", "dim", "first", "second", "chunk", "block", "score", "lo", "hi", "rest", "done"]
    for search in (topk.exact_top_k, multi_index.nearest):
        assert sorted(map(tuple, search(clashing(rows, names)).collect())) == sorted(map(tuple, search(rows).collect()))


# packing


def check_packing(docs: pd.DataFrame, out: pd.DataFrame, capacity: int):
    size = {i: len((t or "").encode()) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    whole = out.groupby("doc_id")["length"].sum()
    assert {i: int(whole[i]) for i in size} == size
    key = {i: (s, " ".join((t or "").lower().split())) for i, s, t in zip(docs["doc_id"], docs["source"], docs["text"], strict=True)}
    for _, b in out.groupby(["bin_group", "bin"]):
        b = b.sort_values("offset")
        assert b["length"].sum() <= capacity
        assert list(b["offset"]) == list(np.cumsum([0, *b["length"][:-1]]))
        sources = [key[i][0] for i in b["doc_id"]]
        clusters = [key[i][1] for i in b["doc_id"] if key[i][1]]
        assert len(sources) == len(set(sources)) and len(clusters) == len(set(clusters))


def plain_packing(rows, capacity):
    """{(row, piece): (bin, offset)} of (row, size, tie, sources, clusters): every bin is looked at for every piece."""
    pieces = [(i, p, min(capacity, size - p * capacity), tie, src, cl) for i, size, tie, src, cl in rows for p in range(max(1, -(-size // capacity)))]
    bins: list[list] = []  # used, sources, clusters
    want = {}
    for i, p, length, _, src, cl in sorted(pieces, key=lambda x: (-x[2], x[3], x[1])):
        fits = [(capacity - b[0], k) for k, b in enumerate(bins) if b[0] < capacity and b[0] + length <= capacity and not b[1] & src and not b[2] & cl]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set(), set()])
        want[i, p] = (k, bins[k][0])
        bins[k][0] += length
        bins[k][1] |= src
        bins[k][2] |= cl
    return want


def test_packing_is_whole_and_without_conflict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(docs.toPandas(), packing.best_fit_pack(docs, 4096, 2).toPandas(), 4096)


def test_packing_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"part": 0, "no_id": 0, "id": np.arange(n), "no_source": 0, "source": rng.integers(0, 7, n), "size": rng.integers(0, 250, n), "cluster": rng.integers(0, 120, n), "near": rng.integers(0, 90, n), "copy": 0})
    got = packing.pack_group(pdf, 100)
    rows = [(r.id, r.size, r.id, {r.source}, {("c", r.cluster), ("n", r.near)} if r.size else set()) for r in pdf.itertuples()]
    assert {(int(r.id), int(r.piece)): (int(r.bin), int(r.offset)) for r in got.itertuples()} == plain_packing(rows, 100)


def test_packing_query_equals_brute_force(spark):
    """The whole registered query: groups by the documented hash, clusters by normalised text and by plain components, every bin searched."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pdf = docs.toPandas()
    near = plain_components({i: plain_fingerprint(t) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)})
    bits = packing.group_bits_of(len(pdf))
    rows = [(int(i), len(t.encode()), int(i), {s}, {("c", " ".join(t.lower().split())), ("n", near[i])} if t else set()) for i, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True)]
    assert bits == 0 and not pdf["source"].isna().any() and len({r[1] for r in rows}) < len(rows)
    got = {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in Q.op1_best_fit_packing(spark, SF).collect()}
    assert got == plain_packing(rows, packing.CAPACITY)


def test_packing_parts_near_copies(spark):
    """Linked near copies, and copies with other white space at their ends, of different sources: each in a bin of its own."""
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "\n\tshort one\n", "Short  one", "short one\t"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)], DOC)
    assert len({r["component_id"] for r in simhash.near_duplicates(docs.where("doc_id < 2")).collect()}) == 1
    at = {r["doc_id"]: (r["bin_group"], r["bin"]) for r in packing.best_fit_pack(docs).collect()}
    assert at[0] != at[1] and len({at[2], at[3], at[4]}) == 3
    for a, b in (("\nabc", "abc"), (" abc", "abc"), ("\n abc \t", "ABC")):
        two = spark.createDataFrame([(0, a, "en", "s", 1), (1, b, "en", "t", 1)], DOC)
        assert len({r["bin"] for r in packing.best_fit_pack(two, near=False).collect()}) == 2


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [2**53 + 1, 2**53, 2**53 + 2, -(2**63), 2**63 - 1, None, 0, None]
    docs = spark.createDataFrame([(i, f"text number {k}", "en", None if k % 2 else "s", 1) for k, i in enumerate(ids)], DOC)
    for near in (True, False):
        got = [r["doc_id"] for r in packing.best_fit_pack(docs, near=near).collect()]
        assert sorted(got, key=str) == sorted(ids, key=str)
    # Equal sizes go by id, null last.
    assert [r["doc_id"] for r in packing.best_fit_pack(docs, 13, near=False).orderBy("bin").collect()] == sorted([i for i in ids if i is not None]) + [None, None]


def test_packing_places_rests_by_their_own_size(spark):
    """The rest of 30 comes after the texts of 60 and 40, which fill a bin: pieces are sorted, not documents."""
    docs = spark.createDataFrame([(0, "a" * 130, "en", "s", 1), (1, "b" * 60, "en", "t", 1), (2, "c" * 40, "en", "u", 1)], DOC)
    at = {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in packing.best_fit_pack(docs, 100, near=False).collect()}
    assert at == {(0, 0): (0, 0), (1, 0): (1, 0), (2, 0): (1, 60), (0, 1): (2, 0)}


def test_packing_groups_split_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 10)
    docs = spark.createDataFrame([(5, "same", "en", "s", 1)] * 95 + [(None, None, None, None, None)] * 33, DOC)
    out = packing.best_fit_pack(docs, 100, 3).toPandas()
    assert len(out) == 128 and set(out["bin_group"]) == set(range(8)) and out.groupby(["bin_group", "bin"])["doc_id"].count().max() == 1
    assert [packing.group_bits_of(n) for n in (0, 1, 1024, 1025, 2048, 2049)] == [0, 0, 0, 1, 1, 2]


def test_packing_odd_rows(spark, odd):
    out = packing.best_fit_pack(odd, 1000).toPandas()
    assert out["doc_id"].isna().sum() == 1 and (out["doc_id"] == 3).sum() == 2 and set(out["doc_id"].dropna()) == set(range(len(ODD)))
    assert packing.best_fit_pack(empty(spark)).count() == 0


# sharding


def unsigned(x: int) -> int:
    return x % (1 << 64)


def plain_nodes(shards, vnodes=128):
    """[(cell, shard)] around the ring: node v of a shard lies in the cell of the first 20 bits of XXH64("shard/v"); where an earlier shard
    has that cell, of XXH64("shard/v/k") for the first k = 1, 2, ... whose cell is free."""
    taken = {}
    for name in ((s, v) for s in range(shards) for v in range(vnodes)):
        tries = [f"{name[0]}/{name[1]}"] + [f"{name[0]}/{name[1]}/{k}" for k in range(1, 50)]
        cell = next(c for c in (xxhash.xxh64_intdigest(t) // 2**44 for t in tries) if c not in taken)
        taken[cell] = name[0]
    return sorted(taken.items())


def plain_ring(keys, shards):
    """[(shard, slot)] of each (cell, item), given in ring order, one row at a time: every arc offers its rows to its node; those that find
    the shard full go on to the next node, round by round, in the order of the arcs."""
    nodes = plain_nodes(shards)
    room = [len(keys) // shards + (1 if s < len(keys) % shards else 0) for s in range(shards)]
    used = [0] * shards
    arcs = [[] for _ in nodes]
    late = [(c, i) for c, i in keys if c > nodes[-1][0]]
    for c, i in late + [(c, i) for c, i in keys if c <= nodes[-1][0]]:
        arcs[next((k for k, (cell, _) in enumerate(nodes) if cell >= c), 0)].append(i)
    out, turn = {}, [(k, list(items)) for k, items in enumerate(arcs) if items]
    while turn:
        after = []
        for k, items in turn:
            shard = nodes[k][1]
            while items and used[shard] < room[shard]:
                out[items.pop(0)] = (shard, used[shard])
                used[shard] += 1
            if items:
                after.append(((k + 1) % len(nodes), items))
        turn = after
    return out


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_ring_equals_sequential_placement(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = ring.bounded_ring(docs, shards).toPandas()
    spots = docs.select("doc_id", F.xxhash64("doc_id", F.crc32("text")).alias("h")).collect()
    # Cells in ring order; inside a cell by the signed hash.
    keys = sorted((unsigned(r["h"]) >> 44, r["h"], r["doc_id"]) for r in spots)
    assert {int(r.doc_id): (r.shard, r.slot) for r in out.itertuples()} == plain_ring([(c, i) for c, _, i in keys], shards)
    n = out["shard"].value_counts().reindex(range(shards), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_ring_values_and_movement(spark, odd):
    out = ring.bounded_ring(odd, 4).toPandas()
    assert len(out) == len(ODD) + 2
    by = {i: g.iloc[0] for i, g in out.groupby("doc_id")}
    for i, t in enumerate(ODD):
        assert by[i]["size"] == len((t or "").encode()) + 1 and by[i]["text_crc32"] == zlib.crc32((t or "").encode())
    assert ring.bounded_ring(empty(spark), 4).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a, b = (ring.bounded_ring(docs, s).toPandas().set_index("doc_id")["shard"] for s in (16, 17))
    assert (a != b.reindex(a.index)).mean() < 0.15  # 1 / 17 must move; modulo hashing moves 0.94
    fewer = ring.bounded_ring(docs.where("doc_id % 100 <> 7"), 16).toPandas().set_index("doc_id")["shard"]
    assert (a.reindex(fewer.index) != fewer).mean() < 0.02


def test_ring_with_half_the_rows_alike(spark, monkeypatch):
    """Null ids and equal texts on half the rows, repeats of others: counts, slots, and equal rows side by side in each shard."""
    monkeypatch.setattr(common, "COPIES", 64)
    rows = [(None, "again", "en", "s", 1)] * 500 + doc_rows([f"t{i}" for i in range(400)]) + doc_rows(["t0", "t1"]) * 50
    out = ring.bounded_ring(spark.createDataFrame(rows, DOC), 7).toPandas()
    assert len(out) == 1000 and out["doc_id"].isna().sum() == 500
    n = out["shard"].value_counts()
    assert n.max() - n.min() <= 1 and n.size == 7
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
        for _, same in g.fillna(-1).groupby(["doc_id", "text_crc32"]):
            assert len(same) <= 500
    tail = out[out["doc_id"].isna()]
    # The hot key fills whole shards clockwise: all but its first and last shard hold nothing else behind its first slot there.
    assert tail["shard"].nunique() >= 500 // (1000 // 7 + 1)


# chat


def test_chat_round_trip(spark):
    says = ["<|im_end|><|im_start|>assistant ok", "~0~1~2<~2|<|", "", "a\nb", "<", "|x", None, "é🙂~"]
    rows = [(c, t, r, s) for c in range(3) for t, (r, s) in enumerate(zip(["system", "user", "assistant", "us\ner~<|", "assistant", "user", None, "assistant"], says[c:] + says[:c], strict=True))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)))
    for r in out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_learned(F.col("segments")).alias("learned")).collect():
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == mine
        assert r["learned"] == "".join(t for role, t in mine if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


@pytest.mark.parametrize(("roles", "state", "valid"), [("ua", "answered", True), ("suaua", "answered", True), ("u", "asked", False), ("a", "stuck at 0", False), ("uau", "asked", False), ("uua", "stuck at 1", False), ("us", "stuck at 1", False)])
def test_chat_states(spark, roles, state, valid):
    names = {"u": "user", "a": "assistant", "s": "system"}
    df = spark.createDataFrame([(1, i, names[r], "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).first()
    assert (got["state"], got["valid"], got["n_turns"]) == (state, valid, len(roles))


def test_chat_empty_and_native(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).count() == 0
    assert "Python" not in chat.format_chats(none)._jdf.queryExecution().toString()


# toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op4_toxicity(spark, sf).toPandas()
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got[got["held_out"]].merge(lab, on="doc_id")
    rank = m["score"].rank()
    pos = m["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (m["predicted"][~pos] == 1).mean() < 0.01 and m["predicted"][pos].mean() > 0.8
    assert ((got["predicted"] == 1) == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all() and len(got) == 10_000


def small_net():
    return toxicity.train([f"w{i} bad{i % 3} x" if i % 2 else f"good w{i}" for i in range(60)], np.arange(60) % 2 == 1, ["en"] * 60)


def test_toxicity_forward_equals_loops():
    net = small_net()
    texts = ["w1 bad0 x y z bad1", "", "good", None]
    ids, _, first = toxicity.features_in_parts(texts)
    v = toxicity.embed(net, ids)
    got, places = toxicity.forward(net, v, first)
    for d in range(len(texts)):
        x, want = v[first[d] : first[d + 1]], []
        for wi, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                a = [max(0.0, float(net.bias[wi][f] + sum(x[p + o] @ net.conv[wi][o][:, f] for o in range(width) if p + o < len(x)))) for p in range(len(x))]
                want.append(max(a, default=0.0))
                if a and want[-1] > 1e-3:
                    assert a[places[wi][d, f] - first[d]] >= want[-1] - 1e-5
        assert np.allclose(got[d], want, atol=1e-5)


def test_toxicity_gradients_equal_differences():
    net = small_net()
    ids, _, first = toxicity.features_in_parts(["w1 bad0 x y z bad1", "good w3 x", "", "bad2 w5"])
    v = toxicity.embed(net, ids).astype(np.float64)
    net.conv, net.bias, net.out = [c.astype(np.float64) for c in net.conv], [b.astype(np.float64) for b in net.bias], net.out.astype(np.float64)
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        p = toxicity.raw(net, toxicity.forward(net, v, first)[0].astype(np.float64))
        decay = toxicity.DECAY / 2 * (sum((c**2).sum() for c in net.conv) + (net.out**2).sum())
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + decay

    (base, out, *rest), words = toxicity.gradients(net, v, first, y, weight)
    step, rng = 1e-4, np.random.default_rng(1)
    for grad, param in [(out, net.out), *zip(rest, [*net.conv, *net.bias], strict=True), (words, v)]:
        for at in rng.choice(param.size, min(12, param.size), replace=False):
            old = param.flat[at]
            param.flat[at] = old + step
            up = loss()
            param.flat[at] = old - step
            down = loss()
            param.flat[at] = old
            assert abs((up - down) / (2 * step) - grad.flat[at]) < 2e-3
    old = net.base
    net.base = old + step
    up = loss()
    net.base = old - step
    assert abs((up - loss()) / (2 * step) - base) < 2e-3


def test_toxicity_cuts_by_language(monkeypatch):
    """Each language with enough labels of both kinds has the cut of its own rows, the others that of all."""
    rng = np.random.default_rng(4)
    texts, langs, toxic = [], [], []
    for i in range(400):
        lang = ("en", "de")[i // 4 % 2] if i < 392 else "xx"
        toxic.append(i % 3 == 0)
        texts.append(f"{lang}only {lang}word{i % 7} " + ("bad" if toxic[-1] else "good") + f" n{rng.integers(0, 50)}")
        langs.append(lang)
    asked = []
    plain = toxicity.best_cut
    monkeypatch.setattr(toxicity, "best_cut", lambda p, y: asked.append((len(p), plain(p, y))) or asked[-1][1])
    net = toxicity.train(texts, np.array(toxic), langs)
    assert net.langs == ["de", "en", "xx"] and len(asked) == 3 and asked[0][0] == 100
    assert list(net.cut) == [asked[1][1], asked[2][1], asked[0][1]]
    p, y = np.array([0.9, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0])
    assert plain(p, y) == pytest.approx(0.7) and plain(p, 0 * y) >= 0.9
    text = ["enonly enword1 bad n3"]
    raw, guess = toxicity.predict_raw(net, *toxicity.features_in_parts(text))
    assert net.langs[guess[0]] == "en" and (toxicity.scores(net, text)[0] >= 0.5) == (raw[0] >= net.cut[1])


def test_toxicity_learning_rows_are_bounded_in_letters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 100)
    monkeypatch.setattr(toxicity, "MOST_LETTERS", 1000)
    docs = spark.createDataFrame(doc_rows(["a " * 40] * 100 + ["b " * 400] * 50 + [None] * 5), DOC)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(155)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, labels)
    assert got["text"].str.len().max() == 80 and sorted(got.groupby("toxic")["text"].count()) == [12, 12]


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(ODD))] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs, lab in ((odd, labels), (odd, labels.limit(0)), (empty(spark), labels)):
        out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab)).toPandas()
        assert len(out) == docs.count() and out["toxic_score"].between(0, 1).all()


# language


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op5_language(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.97 and got["score"].between(0, 1).all()


def test_viterbi_equals_exhaustive_search():
    import itertools

    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 5, 3, 6])
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 4, (first[-1], 3)).astype(np.float32)
    path = langid.viterbi(score, first, 3.0)
    for d, n in enumerate(sizes):
        s = score[first[d] : first[d + 1]]
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if n:
            assert np.isclose(value(path[first[d] : first[d + 1]]), max(map(value, itertools.product(range(3), repeat=int(n)))), atol=1e-3)


@pytest.mark.parametrize("block", [2, 5])
def test_viterbi_in_blocks_equals_whole(monkeypatch, block):
    rng = np.random.default_rng(6)
    sizes = np.array([0, 1, 40, 3, 61, 200, 7, 10])
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 4, (first[-1], 4)).astype(np.float32)
    whole = langid.viterbi(score, first, 3.0)
    monkeypatch.setattr(langid, "BLOCK", block)
    assert (langid.viterbi(score, first, 3.0) == whole).all()


def test_one_text_of_a_million_words():
    import time

    m = langid.fit(["the word of the day is here", "das Wort des Tages ist hier"], ["en", "de"])
    text = "the word of " * 250_000 + "das Wort des " * 83_000
    start = time.time()
    pred, score, spans = langid.label_texts(m, [text, "das Wort"])
    assert pred == ["en", "de"] and spans[0] == 2 and 0.6 < score[0] < 0.8 and time.time() - start < 60


def test_language_counts_by_executors_equal_local_ones(spark, monkeypatch):
    rows = [(i, f"{'the word of' if i % 2 else 'das Wort des'} w{i}", "en" if i % 2 else "de", "s", 1) for i in range(40)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    want = langid.fit([r[1] for r in held], [r[2] for r in held])
    got = langid.fit_languages(spark.createDataFrame(rows, DOC).repartition(5))
    assert got.langs == want.langs and np.allclose(got.table, want.table, atol=1e-6) and (got.scripts == want.scripts).all()


def test_language_spans_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    m = langid.fit(docs["text"].tolist(), docs["lang"].tolist())
    en, de = (next(t for t, k in zip(docs["text"], docs["lang"], strict=True) if k == lang and len(t) > 900)[:700] for lang in ("en", "de"))
    pred, score, spans = langid.label_texts(m, [en + "\n" + de + " " + de[:200], "Привет", "123 !", None])
    assert pred[0] == "de" and spans[0] == 2 and 0.4 < score[0] < 0.7 and pred[2:] == ["und", "und"] and score[2] == 0
    out = langid.detect_languages(odd, langid.fit_languages(odd)).toPandas()
    assert len(out) == len(ODD) + 2 and set(out["lang_pred"][out["text"].isin([None, "", "!!"])]) == {"und"}
    assert langid.detect_languages(empty(spark), langid.fit_languages(empty(spark))).count() == 0


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    return path, bpe.Vocabulary(bpe.read_spec(path)), tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(vocabulary, spark):
    _, v, lib = vocabulary
    rng = np.random.default_rng(2)
    texts = [t or "" for t in ODD] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(list(" \n\tabcdefgxyzéñ'.,!0123漢字🙂sdt"), rng.integers(0, 60))) for _ in range(400)] + ["a" * 3000, "<|endoftext|>x<|endoftext|><|endoftext|>", "!?" * 700]
    for t, ids in zip(texts, v.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and v.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_column(vocabulary, spark, odd):
    path, _, lib = vocabulary
    out = bpe.tokenize(odd, path, keep=True).toPandas()
    assert len(out) == len(ODD) + 2
    for t, ids, n, text in zip(out["text"], out["ids"], out["n_tokens"], out["decoded"], strict=True):
        assert list(ids) == lib.encode(t or "", add_special_tokens=False).ids and n == len(ids) and text == (t or "")
    assert bpe.tokenize(empty(spark), path).count() == 0


# licences


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_license_scan(spark):
    rows = [
        ("a/LICENSE", "Permission notice.\nReleased under the MIT License."),
        ("a/b/c/x.py", "no notice"),
        ("a/b/y.py", "intro words\nLicensed under the Apache License, Version 2.0.\n" + "code " * 400),
        ("a/b/NOTICE", "This work is licensed under the GNU General Public License, version 3."),
        ("z.txt", None),
        ("q/w.txt", "my licensee is a person"),
        (None, ""),
        ("a/b/c/x.py", "no notice"),
    ]
    out = licenses.scan_licenses(files_of(spark, rows).withColumn("dir", F.lit(1)))
    assert out.columns == ["path", "dir", *licenses.RESULTS] and out.agg(F.min("dir")).first()[0] == 1
    got = {r["path"]: (r["own_license"], r["license"], r["found_in"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got["a/LICENSE"] == ("MIT", "MIT", "a/LICENSE") and got["a/b/y.py"][0] == "Apache-2.0"
    assert got["a/b/c/x.py"] == (None, "GPL-3.0", "a/b") and got["z.txt"] == (None, None, None) and got["q/w.txt"] == (None, None, None) and got[""] == (None, None, None)
    assert licenses.scan_licenses(files_of(spark, [])).count() == 0


def labels_of(spark, lines, copies=0):
    """The own_license of a file of each line, in a corpus with so many copies of other files."""
    rows = [(f"f{i}/x", s) for i, s in enumerate(lines)]
    mix = [v for k, v in licenses.TEMPLATES.items() if k in ("Apache-2.0", "MIT", "GPL-3.0")] + ["Licensed under CC BY-NC 4.0."]
    rows += [(f"g{i}/y", mix[i % len(mix)]) for i in range(copies)]
    got = {r["path"]: r["own_license"] for r in licenses.scan_licenses(files_of(spark, rows)).collect()}
    return [got[f"f{i}/x"] for i in range(len(lines))]


@pytest.mark.parametrize("copies", [0, 20_000])
def test_every_notice_is_found(spark, copies):
    assert labels_of(spark, [s + "." for _, s in licenses.NOTICES], copies) == [k for k, _ in licenses.NOTICES]
    said = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0, the Creative Commons Attribution-NonCommercial 4.0 License."]
    assert labels_of(spark, said, copies) == ["CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-NC-4.0"]


GNU = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU {} as published by\n    the Free Software Foundation, either version {} of the License, or\n    (at your option) any later version.\n\n"
MIT_BODY = """Copyright (c) 2019 A

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ISC_BODY = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
USUAL = [
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    (GNU.format("General Public License", "3"), "GPL-3.0"),
    (GNU.format("General Public License", "2"), "GPL-2.0"),
    (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
    (GNU.format("Affero General Public License", "3"), "AGPL-3.0"),
    ("GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("BSD 2-Clause License\n\nCopyright (c) 2020, A\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "BSD-2-Clause"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "Apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Licensed under the Apache License, Version 9.0", None),
    ("This is not released under the MIT License.", None),
    ("It was never licensed under the GNU General Public License, version 3.", None),
    ("This project is licensed under the terms of the MIT license.", "MIT"),
    ("Dual licensed under MIT or Apache-2.0.", "MIT OR Apache-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("# SPDX-License-Identifier: Apache-2.0 OR GPL-2.0", "Apache-2.0 OR GPL-2.0"),
    ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("Distributed under GPLv3", "GPL-3.0"),
    ("CC0 1.0 Universal", "CC0-1.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.", "BSD-2-Clause"),
    ("It must not be distributed under the terms of the MIT license.", None),
    ("It may not be released under the MIT License.", None),
    ("This file isn't distributed under the terms of the MIT license, it is Licensed under CC BY 4.0.", None),
    ("The text is not new.\nReleased under the MIT License.", "MIT"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989, 1991 A", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 A", "GPL-3.0"),
    (MIT_BODY, "MIT"),
    ("Copyright (c) 2021, A\n\n" + ISC_BODY, "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nFor more information, please refer to <http://unlicense.org/>", "Unlicense"),
    ("All rights reserved. Copyright 2020 by A.", None),
]


@pytest.mark.parametrize("copies", [0, 20_000])
def test_usual_headers_have_one_label_at_any_size(spark, copies):
    assert labels_of(spark, [s for s, _ in USUAL], copies) == [k for _, k in USUAL]


def test_licenses_of_repeated_paths_and_long_texts(spark):
    """Texts of one path each have their own match, the smallest of them counts for the directory; a text of megabytes is read whole."""
    long = "some words that say nothing " * 100_000 + ". Released under the MIT License."
    rows = [("d/LICENSE", "Released under the MIT License."), ("d/LICENSE", "Licensed under CC BY 4.0."), ("d/LICENSE", "nothing"), ("e/long.txt", long), ("e/x", "")] + [("f/y", "Released under the MIT License.")] * 50
    got = licenses.scan_licenses(files_of(spark, rows)).toPandas()
    assert len(got) == len(rows)
    own = got[got["path"] == "d/LICENSE"]
    assert sorted(map(str, own["own_license"])) == ["CC-BY-4.0", "MIT", "None"] and own["license"].isna().sum() == 0
    assert list(got[got["path"] == "e/long.txt"]["own_license"]) == ["MIT"] and got[got["path"] == "e/x"]["license"].isna().all()
    assert set(got[got["path"] == "f/y"]["cosine"]) == {1.0}


def test_native_plans_have_no_python(spark):
    rows = files_of(spark, [("a/LICENSE", "Released under the MIT License.")])
    for plan in (licenses.matches(rows.select("path", F.lit(1).alias("th"), F.lit(5).alias("n_words"), F.posexplode(licenses.statements(F.col("text"))).alias("at", "said"))), licenses.scan_licenses(rows)):
        assert not any(x in plan._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


def test_license_scan_equals_brute_force(spark):
    import math
    import re

    sf = "/root/testdata/sf0.01"
    got = Q.op7_license_scan(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    words = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    n = len(licenses.NOTICES)
    df = pd.Series([w for _, s in licenses.NOTICES for w in set(words(s))]).value_counts().to_dict()
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
    vec = lambda t: {w: words(t).count(w) * idf(w) for w in set(words(t))}
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    notices = [(name, vec(t)) for name, t in licenses.NOTICES]
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        said = [s for rx in (r"\n+|(?<=[.!?;])\s+", r"\n\s*\n|(?<=[.!?;])(?<!\bv\.)\s+") for s in re.split(rx, t) if re.search(licenses.CUE, s) and not re.search(licenses.NOT, s)]
        fits = [(-round(cos(vec(s), v), 9), name) for s in said for name, v in notices if all(w in vec(s) for w in v if w[0].isdigit())]
        score, name = min(fits, default=(0, None))
        want = (name, round(-score, 6)) if -score >= licenses.LEAST else (None, 0.0)
        assert (got["own_license"][i], round(got["cosine"][i], 6)) == want
    assert got["own_license"].notna().sum() >= 10


# vectors


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def odd_vectors(n=240, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d)], 0) for i in range(n)]
    for i in range(60, 160):
        rows[i] = (i, rows[0][1], 0)  # a very common vector
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * d, 0), (1003, [float("nan")] + [1.0] * (d - 1), 0), (1004, [float("inf")] * d, 0), (1005, [None] + [1.0] * (d - 1), 0), (None, rows[1][1], 0), (1006, [1.0, 2.0], 0), (1020, [2.0, 1.0], 0)]
    repeats = [rows[5], rows[40], rows[40], rows[40], rows[7], (80, rows[81][1], 0), (20, rows[33][1], 0)]
    return rows + bad + repeats


def brute(rows, every, k, score, nonzero):
    """Every row is a candidate as often as it occurs; an id asks once, with its smallest vector, and leaves out the rows of its own id."""
    ok = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v))]
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        own = np.array(min(v for i, v in ok if i == q), float)
        s = sorted((-score(own, np.array(v, float)), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out.update({(q, r + 1): (i, -x) for r, (x, i) in enumerate(s)})
    return out


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(vectors_of(spark, rows), 20, 20).collect()}
    assert got == brute(rows, 20, 20, lambda a, b: int((np.floor(64 * a) * np.floor(64 * b)).sum()), False)
    assert topk.exact_top_k(vectors_of(spark, [])).count() == 0
    few = vectors_of(spark, rows[:4])
    assert topk.exact_top_k(few, 20, 1).count() == 12


def test_top_k_in_batches_and_many_tasks(spark, monkeypatch):
    """Small batches of queries, rows dealt to many tasks, and sums beyond 2^53 give the same as brute force."""
    rows = odd_vectors(200)
    score = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(np.floor(64 * a), np.floor(64 * b), strict=True)))
    want = brute(rows, 7, 5, score, False)
    monkeypatch.setattr(topk, "QUERIES", 6)
    monkeypatch.setattr(topk, "AT_ONCE", 4)
    df = vectors_of(spark, rows).repartition(13)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, 5, 7).collect()} == want
    large = [(i, [x * 2.0**22 for x in v] if v and i is not None and i < 100 else v, 0) for i, v, _ in rows]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(vectors_of(spark, large), 5, 7).collect()}
    assert got == brute(large, 7, 5, score, False)


def test_multi_index_recall_and_scores(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = multi_index.nearest(emb).toPandas()
    rows = [(r["vec_id"], r["embedding"], 0) for r in emb.collect()]
    x = np.array([r[1] for r in rows], float)
    ids = np.array([r[0] for r in rows])
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        best = ids[np.argsort(-s, kind="stable")[:5]]
        hits += len(set(best) & set(g["vec_id"]))
        total += 5
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
        for i, c in zip(g["vec_id"], g["score"], strict=True):
            assert abs(s[ids == i][0] - c) < 1e-12
    assert hits / total >= 0.9


def test_multi_index_with_full_budget_is_exact(spark):
    rows = odd_vectors()
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in multi_index.nearest(vectors_of(spark, rows), 5, 20, wanted=1.0).collect()}
    want = brute(rows, 20, 5, cos, True)
    assert {k: v[1] for k, v in got.items()} == {k: round(v[1], 9) for k, v in want.items()}
    assert multi_index.nearest(vectors_of(spark, [])).count() == 0


def test_walk_takes_cells_by_distance():
    rng = np.random.default_rng(4)
    da, db, count = rng.random(7), rng.random(9), np.ones((7, 9), int)
    got = [da[a] + db[b] for a, b in multi_index.walk(da, db, count, 63)]
    assert len(got) == 63 and got == sorted(got)


def test_multi_index_always_finds_k(spark):
    """A budget of next to nothing still leaves k candidates, all of them if there are fewer, and codebooks grow with the table."""
    rows = [(i, v, 0) for i, v, _ in odd_vectors()[:240]]
    fit = multi_index.fit
    try:
        multi_index.fit = lambda *a: (lambda b: setattr(b, "share", 0.0) or b)(fit(*a))
        got = multi_index.nearest(vectors_of(spark, rows), 5, 20).toPandas()
        assert (got.groupby("query_id")["vec_id"].count() == 5).all() and got["query_id"].nunique() == 12
        assert multi_index.nearest(vectors_of(spark, rows[:4]), 5, 1).count() == 12
    finally:
        multi_index.fit = fit
    assert [multi_index.centroids(n) for n in (1, 500, 50_000, 10**7, 10**10, 10**13)] == [16, 16, 64, 256, 1024, 1024]


# near-duplicates


def plain_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hashes_equal_the_library():
    from pulsegrid.llm import xxh

    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    size = np.concatenate([np.arange(0, 130), rng.integers(0, 700, 300), [256, 257, 0]])
    start = rng.integers(0, 5000 - size + 1)
    for seed in (0, 42):
        assert xxh.hashes(data, start, start + size, seed).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    assert len(xxh.hashes(b"", start[:0], start[:0], 1)) == 0


def test_fingerprints_of_many_texts_together():
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\x0b", "one", "One  TWO", "a b c", "a b c d", "É ü\u00a0x y\x1cz", "w" * 5000 + " x y z q", *(" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in (253, 254, 257, 258, 259, 513, 1025, 5)), None, "again again again again again"]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]
    assert len(simhash.fingerprints_of([])) == 0 and simhash.fingerprints_of([None, ""]).tolist() == [0, 0]


def plain_components(fps: dict) -> dict:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps)


def test_trie_join_equals_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    v = np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, k)).astype(np.uint64), axis=1) for k in (1, 2, 3, 5, 6)])
    v = np.unique(v)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    pairs = list(simhash.trie_links(v, 0, 4))
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    d = np.bitwise_count(v[:, None] ^ v[None])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(d <= 4), strict=True) if a < b}


def test_dense_group_of_near_copies(spark):
    """Some thousand fingerprints within a few bits of each other, and a stranger: two components, and as many links as rows."""
    rng = np.random.default_rng(9)
    base = np.uint64(0x1234567890ABCDEF)
    v = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4000, 2)).astype(np.uint64), axis=1))
    v = np.append(v, ~base).view(np.int64)
    distinct = spark.createDataFrame(pd.DataFrame({"fp": v}))
    edges = simhash.links(distinct, len(v))
    assert edges.count() < 5 * len(v)
    got = simhash.components(edges).toPandas()
    assert got["root"].nunique() == 1 and len(got) == len(v) - 1


def test_chain_of_links_is_one_component(spark):
    fps = [0]
    for k in range(15):
        fps.append(fps[-1] | 0b1111 << (4 * k))
    distinct = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp long")
    got = simhash.components(simhash.links(distinct, len(fps))).toPandas()
    assert got["root"].nunique() == 1 and len(got) == len(fps)


def test_simhash_odd_rows(spark, odd):
    out = simhash.near_duplicates(odd).toPandas()
    assert len(out) == len(ODD) + 2
    zero = out[out["doc_id"].isin([0, 1, 2])]
    assert set(zero["fingerprint"]) == {"0" * 16} and set(zero["component_id"]) == {0}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and ids.count(3) == 1 and 10 not in ids and 1 not in ids
    assert simhash.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("c", [1, 2, 3])
def test_more_blocks_give_the_same_components(spark, monkeypatch, c):
    """Any choice of blocks, with groups cut into parts, finds the components of all pairs."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    v = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, k)).astype(np.uint64), axis=1) for k in (1, 2, 3, 4, 5, 7)]))
    choice = simhash.Blocks(4, c)
    assert len(choice.choices) == {1: 5, 2: 15, 3: 35}[c]
    for turn in range(len(choice.choices)):
        shuffled = choice.arranged(v, turn)
        assert (np.bitwise_count(shuffled) == np.bitwise_count(v)).all() and len(np.unique(shuffled)) == len(v)
        key = spark.createDataFrame(pd.DataFrame({"fp": v.view(np.int64)})).select(choice.key(F.col("fp"), turn, 9).alias("k")).toPandas()["k"]
        assert (key.to_numpy(np.uint64) == shuffled >> np.uint64(55)).all()
    monkeypatch.setattr(simhash, "blocks_for", lambda n, budget: (choice, 3))
    monkeypatch.setattr(simhash, "SPLIT", 8)
    got = simhash.components(simhash.links(spark.createDataFrame(pd.DataFrame({"fp": v.view(np.int64)})), len(v))).toPandas()
    want = plain_components({int(x): int(x) for x in v})
    groups = lambda of: sorted(sorted(g) for g in pd.Series(of).groupby(of).groups.values() if len(g) > 1)
    assert groups({int(x) % (1 << 64): y for x, y in zip(got["node"], got["root"], strict=True)}) == groups(want)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n)[1] for n in (0, 1, 4096, 4097, 1 << 20)] == [0, 0, 0, 1, 8]
    few, many, most = (simhash.blocks_for(n)[0] for n in (1 << 24, 1 << 32, 1 << 40))
    assert (len(few.choices), len(many.choices), len(most.choices)) == (5, 15, 35) and simhash.blocks_for(1 << 32)[1] == 20


def test_one_fingerprint_on_half_the_rows(spark):
    """Empty texts on half of the rows: one component, and one row of it stays."""
    docs = spark.createDataFrame(doc_rows(["" if i % 2 else f"word{i} other{i * 7} third{i * 13} fourth{i * 17} fifth" for i in range(2000)]), DOC).repartition(8)
    got = simhash.near_duplicates(docs).toPandas()
    zero = got[got["fingerprint"] == "0" * 16]
    assert len(got) == 2000 and len(zero) >= 1000 and zero["component_id"].nunique() == 1
    assert simhash.one_of_each(docs).count() == got["component_id"].nunique()


def test_one_row_of_each_component(spark):
    """Exact repeats of the kept row, rows without an id that copy each other or a named row, two texts of one id."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, long, "b"), (3, long, "a"), (None, long, "c"), (None, "no id here at all my friend", "x"), (None, "no id here at all my friend", "x"), (7, "quite other words stand in here", "x"), (7, long, "x"), (8, None, "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 5):
        got = simhash.one_of_each(docs.repartition(parts)).toPandas()
        assert list(got.columns) == docs.columns
        assert sorted((str(i), str(t)) for i, t in zip(got["doc_id"].astype("Int64"), got["text"], strict=True)) == sorted([("3", long), ("<NA>", rows[3][1]), ("7", rows[5][1]), ("8", "None")])
        source = got[got["doc_id"] == 3]["source"].item()
        assert parts == 1 or source == before
        before = source


def test_multi_index_blocks_of_queries(spark, monkeypatch):
    """With small blocks no task meets more queries than about a block, and the result is the same."""
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    read = lambda: sorted(map(tuple, multi_index.nearest(emb, every=5).collect()))
    want = read()
    most = spark.sparkContext.accumulator(0)
    plain, size = multi_index.rerank, 8

    def counted(key, queries, entries):
        if len(queries) > 4 * size:
            most.add(1)
        return plain(key, queries, entries)

    monkeypatch.setattr(multi_index, "QUERIES", size)
    monkeypatch.setattr(multi_index, "rerank", counted)
    assert read() == want and want and most.value == 0


# learning samples


def test_learning_samples_count_repeats_once(spark, monkeypatch):
    """One row a few thousand times among others: the samples hold it once, others stay, and the order of rows doesn't matter."""
    rows = doc_rows([f"text {i} of many words" for i in range(300)])
    odd = [(7, f"text {j} under one id", "en", "s", 1) for j in range(3)]
    docs = spark.createDataFrame(rows + odd + [(8, "again and again", "en", "s", 1)] * 4000, DOC)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(langid, "PER_LANG", 100)
    a, b = (toxicity.sample(d, labels) for d in (docs, docs.orderBy(F.desc("text"))))
    assert a.equals(b) and not a["doc_id"].duplicated().any()
    one, two = (sorted(r["text"] for r in langid.sample(d)[0].collect()) for d in (docs, docs.orderBy(F.desc("text"))))
    assert one == two and 60 < len(one) <= 100 and one.count("again and again") <= 1


# pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    frames = [docs]
    for _, f in P.STAGES:
        frames.append(f(spark, frames[-1], sf).cache())
    a, b, c, d = (x.toPandas() for x in frames[1:])
    for x in (a, b, c):
        assert list(x.columns) == docs.columns and not x["doc_id"].duplicated().any()
    net = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    whole = docs.toPandas()
    assert set(a["doc_id"]) == set(whole["doc_id"][toxicity.scores(net, whole["text"].tolist()) < 0.5])
    assert len(a) > 0.85 * len(whole) and len(b) > 0.99 * len(a)
    roots = plain_components({i: plain_fingerprint(t) for i, t in zip(b["doc_id"], b["text"], strict=True)})
    assert set(c["doc_id"]) == set(roots.values())
    check_packing(c, d, packing.CAPACITY)
    again = P.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "begin", "length", "bin_group", "bin", "offset"]
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, d[key].values.tolist()))


def test_pipeline_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as P

    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        for k, (_, f) in enumerate(P.STAGES):
            docs2 = f(spark, docs, sf)
            docs2.count()
            if k < 3:
                assert docs2.columns == docs.columns
                docs = docs2
