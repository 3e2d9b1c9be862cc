"""Conversation repair and benchmark decontamination against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate as D
from pulsegrid.llm import queries as Q
from pulsegrid.llm import repair as R

TURN = "conv_id long, turn long, role string, text string"
WHITE = set(" \t\n\x0b\x0c\r")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# repair


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        inner = [x for x in text if x not in WHITE]
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra over whole (cost, labels) pairs; each pushed path is whole, so ties are settled by whole strings."""
    found = faults(rows)
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, labels, i, out, said = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", out):
            best = min(best or (cost, labels, said), (cost, labels, said))
        if i < len(rows):
            _, _, role, text = rows[i]
            more = found[i] == "truncated"
            moves = [(3, "D", "", ())]
            if found[i] not in ("blank", "duplicate"):
                moves += [(more, "K", role[:1], ((role, text),))] + [(2 + more, "R", r[0], ((r, text),)) for r in ("user", "assistant")]
        else:
            moves = []
        moves += [(2, "I", r[0], ((r, ""),)) for r in ("user", "assistant")]
        for c, label, initial, put in moves:
            now = out + initial
            if (not put or initial) and re.fullmatch(r"s?(ua)*u?", now) and len(now) <= len(rows) + 4:
                heapq.heappush(heap, (cost + c, labels + label, i + (label != "I"), now, said + put))
    return best


def expected(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == c), key=order)
        f = faults(mine)
        cost, audit, said = cheapest(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        told = "\n".join(f"{r}:{t}" for r, t in said)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(f.count(x) for x in R.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


def audit_of(spark, rows):
    frame = spark.createDataFrame(rows, TURN)
    found = R.audited(R.repair_conversations(R.damaged(frame)))
    return {r.conv_id: tuple(r)[1:] for r in found.select("conv_id", "gaps", *R.FAULTS, "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair_equals_a_search_over_whole_strings(spark):
    rng, rows = random.Random(5), []
    for c in range(150):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"])
            text = rng.choice(["Yes.", "no", "What?", "", " \n", None, "Yes.", "a. b", "ok!\t "])
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), role, text))
    want, got = expected(rows), audit_of(spark, rows)
    assert {c: got.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in want} == want
    assert len({w[6] for w in want.values()}) > 40


def test_the_whole_query_against_the_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in Q.op11_structure_repair(spark, sf).collect()}
    assert got == expected(rows)


def test_repair_of_odd_rows_and_extra_columns(spark):
    odd = spark.createDataFrame([(None, 0, "user", "Hi."), (None, None, None, None), (1, 3, "user", "x" * 300_000 + "."), (1, 3, "user", "x" * 300_000 + "."), (2, 0, "assistant", "漢字 🙂 é")], TURN)
    odd = odd.withColumns({c: F.lit("mine") for c in ("fault", "initial", "ways", "last", "edits", "place", "repaired", "audit", "cost", "copy", "kind")})
    got = {r.conv_id: (r.audit, r.duplicate, r.blank, r.cost) for r in R.audited(R.repair_conversations(odd)).collect()}
    # the null conversation has a blank row (null turn first) and a lone question; the twin row is a duplicate
    assert got == {None: ("DKI", 0, 1, 5), 1: ("KDI", 1, 0, 5), 2: ("D", 0, 0, 3)}
    turns = R.repaired_turns(R.repair_conversations(odd)).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, len(r.text)) for r in turns] == [(None, 0, "user", 3), (None, 1, "assistant", 0), (1, 0, "user", 300_001), (1, 1, "assistant", 0)]
    empty = R.audited(R.repair_conversations(spark.createDataFrame([], TURN)))
    assert empty.collect() == [] and empty.columns[-1] == "repaired_sha256"


def test_repaired_conversations_need_no_repair(spark):
    rows = [(c, t, role, f"{c} {t} {role}.") for c in range(20) for t, role in enumerate(["assistant", "user", "user", "system", "assistant", "user"][: 1 + c % 6])]
    turns = R.repaired_turns(R.repair_conversations(spark.createDataFrame(rows, TURN))).where("text <> ''")
    initials = {r.conv_id: r.s for r in turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("s")).collect()}
    assert all(re.fullmatch("s?u?(a?u?)*", s) for s in initials.values())


def test_one_conversation_of_many_rows_is_a_stream(spark):
    n = 40_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    r = R.audited(R.repair_conversations(rows)).collect()[0]
    told = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i}." for i in range(n))
    assert (r.gaps, r.cost, r.illegal, set(r.audit), r.repaired_sha256) == (0, 0, 0, {"K"}, hashlib.sha256(told.encode()).hexdigest())


def test_repair_shuffles_once(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a.")], TURN)
    plan = R.repair_conversations(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_grammar_with_two_roles_for_an_edit_is_an_error(spark):
    with pytest.raises(ValueError, match="one label"):
        R.repair_conversations(spark.createDataFrame([], TURN), R.Grammar(made=("user", "usher")))


# decontamination


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10, shingle=5, containment=1.0):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for doc_id, text in docs:
        w, hit, found, spans = words(text), set(), set(), set()
        for window, ids in windows.items():
            n, k = len(window), min(shingle, len(window))
            for s in range(len(w) - n + 1):
                m = n - k + 1
                if containment >= 1:
                    ok = tuple(w[s : s + n]) == window
                else:
                    ok = sum(tuple(w[s + j : s + j + k]) == window[j : j + k] for j in range(m)) >= -(-m * containment // 1)
                if ok:
                    hit |= set(range(s, s + n))
                    spans.add((s, s + n - 1))
                    found |= ids - {None}
        out.append((doc_id, len(w), len(hit), sorted(spans), sorted(found)))
    return sorted(out, key=str)


def found_by(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.decontaminate(d, b, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(x) for x in r["windows"]], list(r["items"])) for r in rows), key=str)


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 4, 6, 9, 10, 11, 14, 30]))) for i in range(30)]
    items += [(30, items[8][1].upper()), (31, "a a a a a a a a a a a a"), (32, None), (33, " .,; "), (None, say(11)), (34, "É 漢字 ñ " * 4), (5, say(12)), (5, items[5][1])]
    docs = [(i, f"{say(rng.randint(0, 20))}, {rng.choice(items)[1]}; {say(rng.randint(0, 20))}! {rng.choice(items)[1]}") for i in range(60)]
    docs += [(60, None), (61, ""), (62, "..."), (63, "A " * 200), (None, items[5][1]), (None, items[5][1]), (64, "é 漢字 ñ É 漢字 ñ"), (65, say(4000)), (66, items[2][1]), (66, items[2][1])]
    return docs, items


def test_decontamination_equals_brute_force(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert found_by(spark, docs, items) == want
    assert sum(x[2] > 0 for x in want) > 30


@pytest.mark.parametrize("containment,shingle", [(0.5, 5), (0.34, 3), (0.9, 2)])
def test_partial_containment_equals_brute_force(spark, containment, shingle):
    docs, items = planted()
    docs = [d for d in docs if d[0] != 65]
    assert found_by(spark, docs, items, containment=containment, shingle=shingle) == brute(docs, items, shingle=shingle, containment=containment)


def test_decontamination_without_items_or_documents_and_clashes(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("key", "near", "told", "pos", "gram", "cls", "n_words", "windows")})
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.decontaminate(docs, none).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["windows"], r["items"], r.key, r.near) for r in rows] == [(0, 0, [], [], "mine", "mine"), (2, 0, [], [], "mine", "mine")]
    one = spark.createDataFrame([(4, "Two")], "item_id long, text string")
    assert [(r.doc_id, r.n_hit, r["items"]) for r in D.decontaminate(docs, one).orderBy("doc_id").collect()] == [(None, 0, []), (1, 1, [4])]
    assert D.decontaminate(docs.limit(0), one).collect() == []
    with pytest.raises(ValueError, match="shingle"):
        D.decontaminate(docs, one, shingle=11)


def test_the_whole_decontamination_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(i, n, h, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), h > 0) for i, n, h, _, ids in brute(docs, items)]
    assert sorted((tuple(r) for r in Q.op12_decontamination(spark, sf).collect()), key=str) == sorted(want, key=str)
