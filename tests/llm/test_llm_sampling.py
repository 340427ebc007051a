"""Importance resampling, BPE with a compiled lexicon, conversation repair: next to plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakstone.llm import bpe, conversations, importance, lexicon
from cloakstone.llm.queries import WORD_PIECES

# --- importance resampling -------------------------------------------------------------


def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_ranks(docs, target, percent=10, longest=1, buckets=10_000, least_words=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, text in docs for f in grams(text, longest)[1])
    t = Counter(bucket(f) for text in target for f in grams(text, longest)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    rows = []
    for i, text in docs:
        words, found = grams(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(words) >= least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return Counter([(*r[:4], n if n <= drawn else None) for n, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if not r[4]])


def some_docs(n, seed):
    rnd = random.Random(seed)
    words = ["Été", "the", "OF", "x1", "über", "日本", "data", "set", "a" * 80, "q"]
    return [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 60))) + rnd.choice(["", ".", "\n--", "\x00"])) for i in range(n)]


@pytest.mark.parametrize("longest, segments, percent", [(1, 4, 10), (2, 7, 50), (3, 1, 100), (1, 30, 0)])
def test_ranks_are_those_of_plain_python(spark, longest, segments, percent):
    docs = some_docs(300, longest) + [(None, "w " * 30), (None, "v " * 30), (7, None), (8, "")] + [(9, "same text " * 15)] * 120
    frame = spark.createDataFrame([(i, t, "s", 1.5, True) for i, t in docs], "doc_id long, text string, score string, rank double, __row boolean")
    target = [(1, "data set of the über", 3), (2, None, None), (3, "日本 data", 1)]
    aims = spark.createDataFrame(target, "item_id long, text string, n long")
    options = {"percent": percent, "longest": longest, "buckets": 500, "least_words": 10}
    got = importance.ranked(frame.repartition(5), aims, segments=segments, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_ranks(docs, [t for _, t, _ in target], **options)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_ranks_of_names_and_drawn_documents(spark):
    docs = [(f"n{i}", f"word{i % 7} " * 25, i) for i in range(90)]
    frame = spark.createDataFrame(docs, "name string, body string, rank long")
    aims = spark.createDataFrame([("word3 word3",)], "body string")
    rows = importance.ranked(frame, aims, key="name", text="body", percent=20).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 19))
    drawn = importance.draw(frame, aims.withColumnRenamed("body", "text"), key="name", text="body", percent=20)
    assert drawn.columns == frame.columns
    assert {r["name"] for r in drawn.collect()} == {r["name"] for r in rows}


def test_ranks_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.ranked(empty, empty).collect() == []
    docs = [(1, "a b c")]
    got = importance.ranked(spark.createDataFrame(docs, "doc_id long, text string"), empty, least_words=0, percent=100)
    assert Counter(tuple(r) for r in got.collect()) == plain_ranks(docs, [], least_words=0, percent=100)


def test_splitters_cut_evenly_whatever_the_samples(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").alias("c"))
    for samples in (100_000, 200):
        cuts = importance.splitters(rows.repartition(40), ["a", "b", "c"], 8, samples)
        assert len(cuts) == 7
        placed = rows.withColumn("s", importance.segment_of([F.col("a"), F.col("b"), F.col("c")], cuts))
        sizes = [r["count"] for r in placed.groupBy("s").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    one = spark.range(5000).select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("id").alias("c"))  # one hot key
    placed = one.withColumn("s", importance.segment_of([F.col("a"), F.col("b"), F.col("c")], importance.splitters(one, ["a", "b", "c"], 5)))
    assert max(r["count"] for r in placed.groupBy("s").count().collect()) < 2000


@given(st.lists(st.binary(max_size=100), max_size=30))
@settings(max_examples=50, deadline=None)
def test_crc_of_spans(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    at = np.cumsum([0, *map(len, spans)])
    assert importance.crc_of_spans(data, at[:-1], at[1:]).tolist() == [zlib.crc32(s) for s in spans]


# --- lexicon and BPE -------------------------------------------------------------------


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=40))
@settings(max_examples=80, deadline=None)
def test_lexicon_holds_its_words_and_no_others(words, asked):
    read = lexicon.Lexicon(lexicon.compiled(list(words), list(words.values())))
    asked = asked + list(words)
    data = np.frombuffer(b"".join(asked) + b"\0", np.uint8)
    at = np.cumsum([0, *map(len, asked)])
    for word, place in zip(asked, read.places(data, at[:-1], at[1:]).tolist(), strict=True):
        if place < 0:
            assert word not in words
        else:
            assert read.outputs[read.offsets[place] : read.offsets[place + 1]].tolist() == words[word]


def test_lexicon_shares_suffixes():
    stems, ends = [bytes([a, b]) for a in b"abcdefgh" for b in b"ijklmnop"], [b"ing", b"ed", b"s", b"ation"]
    words = [s + e for s in stems for e in ends]
    edges, _, _ = lexicon._states(sorted(words))
    assert len(edges) < 30  # a tree of these words has over 600 states
    read = lexicon.Lexicon(lexicon.compiled(words, [[i] for i in range(len(words))]))
    data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    places = read.places(data, at[:-1], at[1:])
    assert read.outputs[read.offsets[places]].tolist() == list(range(len(words)))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_PIECES)


def awkward_texts(n):
    rnd = random.Random(5)
    pool = "aAzZ09 '’sStrevmlld\n\t.!?#é̂́ßİΣσςᄀ가각日क़ि٣²½_  ​﻿🙂\x00\x1f\x85<|endoftext|>"
    wide = [(0x20, 0x3000), (0x3000, 0xD800), (0xE000, 0x110000)]
    texts = [
        "".join(rnd.choice(pool) if rnd.random() < 0.9 else chr(rnd.randrange(*rnd.choice(wide))) for _ in range(rnd.randrange(40)))
        for _ in range(n)
    ]
    return texts + [
        None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext",
        "'s's'sam don't I'll 'LL ''s '", "x" * 5000, "ab" * 3000 + "é" * 2000, "́", "é" * 50,
    ]


@pytest.mark.parametrize("words", [0, 25, 1 << 17])
def test_ids_are_those_of_the_library(spark, words):
    texts = awkward_texts(3000)
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string, ids array<int>")
    got = bpe.encode_documents(docs, WORD_PIECES, words=words, ids="own").collect()
    tokenizer = library()
    for r in got:
        assert r["own"] == tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, texts[r["doc_id"]]
    assert len(got) == 2 * len(texts) and got[0]["n_tokens"] == "x"


def test_digests_and_decoding_of_whole_documents(spark):
    import __spark_entry__ as contract

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokenizer = library()
    rows = contract.queries()["op12_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    coder = bpe.build(empty, WORD_PIECES)
    assert empty.select(bpe.encode(F.col("text"), coder)).collect() == []
    tokenizer = library()
    lists = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in awkward_texts(50)]
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, ids array<int>")
    for r in ids.withColumn("text", bpe.decode(F.col("ids"), coder)).collect():
        assert r["text"] == tokenizer.decode(r["ids"], skip_special_tokens=False)


def test_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("The cat's the",), ("THE dog <|endoftext|>",), (None,)], "text string").repartition(3)
    with open(WORD_PIECES) as file:
        shared = spark.sparkContext.broadcast(bpe.Coder(file.read()))
    got = {bytes(r["word"]): r["n"] for r in bpe.word_counts(docs, "text", shared).collect()}
    assert got == {b"the": 3, b"cat": 1, b"'s": 1, b"dog": 1}


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as file, pytest.raises((ValueError, KeyError)):
        bpe._checked(file.read())


# --- conversations ---------------------------------------------------------------------

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest and then least edit string, by best-first search over (row, place)."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    need = {0: "u", 1: "u", 2: "a", 3: "u"}
    place_of = {"s": 1, "u": 2, "a": 3}
    while heap:
        cost, audit, i, place, out = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in (0, 3):
            return cost, audit, "\n".join(out)
        wanted = need[place]
        name = "user" if wanted == "u" else "assistant"
        heapq.heappush(heap, (cost + 5, audit + "I", i, place_of[wanted], (*out, f"{name}:")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, place, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra, (role, text) = 5 * (faults[i] == "truncated"), rows[i]
        if role[:1] == wanted or (place == 0 and role[:1] == "s"):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, place_of[role[:1]], (*out, f"{role}:{text}")))
        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, place_of[wanted], (*out, f"{name}:{text}")))
    raise AssertionError


def plain_report(rows):
    """The contract's report of undamaged rows (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        pairs = [r[1:] for r in own]
        faults = Counter(faults_of(pairs))
        illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(pairs, pairs[1:], strict=False))
        cost, audit, text = plain_repair(pairs)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256(text.encode()).hexdigest()
        out[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def some_conversations(n, seed, longest=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", "", None]
    texts = ["Hi.", "no stop", " \t", "", None, "Yes! ", "é?\n", "a" * 300 + ".", "role:text\nmore."]
    rows = []
    for conv in range(n):
        for _ in range(rnd.randrange(1, longest)):
            turn = rnd.choice([None, *range(6)]) if rnd.random() < 0.3 else rnd.randrange(3 * longest)
            text = rnd.choice(texts) if rnd.random() < 0.6 else f"t{rnd.randrange(1000)}" + rnd.choice(["", ".", "?"])
            rows.append((None if conv == 3 else conv, turn, rnd.choices(roles, [9, 9, 4, 1, 1, 1, 1])[0], text))
    return rows


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("spill", [1, 500, 1 << 26])
def test_repairs_are_the_cheapest_and_least(spark, spill):
    rows = some_conversations(400, 1)
    frame = spark.createDataFrame([(*r, "x", True, 1) for r in rows], KIND + ", fault string, dropped boolean, nth int")
    got = {r["conv_id"]: tuple(r) for r in conversations.report(frame.repartition(7), spill=spill).collect()}
    assert got == plain_report(rows)


def test_one_giant_conversation_crosses_batches(spark):
    rnd = random.Random(2)
    texts = [f"text {i}." for i in range(1500)] + ["open", "", "again?"]
    rows = [(5, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(texts)) for t in range(6000)]
    rows += [(6, 1, "user", "Q?"), (6, 1 << 60, "assistant", "A."), ((1 << 62) + 1, 1, "system", "Only.")]
    frame = spark.createDataFrame(rows, KIND)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["conv_id"]: tuple(r) for r in conversations.report(frame, spill=20_000).collect()}
        turns = conversations.repaired(frame, spill=20_000).where("conv_id = 5").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    want = plain_report(rows)
    assert got == want
    assert [r["position"] for r in turns] == list(range(len(turns)))
    assert "".join(r["edit"] for r in turns) == want[5][7].replace("D", "")
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == want[5][8]


def test_repaired_turns_fit_the_pattern(spark):
    frame = spark.createDataFrame(some_conversations(200, 3), KIND)
    turns = conversations.repaired(frame).collect()
    per = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["position"]):
        per[r["conv_id"]].append(r["role"][0])
    assert per and all(re.fullmatch("s?(ua)+", "".join(v)) for v in per.values())


def harmed(rows):
    def shown(value):
        return " " if value is None else value

    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def test_damage_and_report(spark):
    import __spark_entry__ as contract

    rows = some_conversations(500, 4, 6)
    got = {r["conv_id"]: tuple(r) for r in conversations.report(conversations.damaged(spark.createDataFrame(rows, KIND)), "dropped").collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: (c, *nothing) for c in {r[0] for r in rows}} | plain_report(harmed(rows))
    assert got == want and any(v[1:] == nothing for v in got.values())
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r) for r in contract.queries()["op13_conversation_repair"](spark, SMALL).collect()}
    assert got == {c: (c, *nothing) for c in {r[0] for r in table}} | plain_report(harmed(table))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], KIND)
    assert conversations.report(conversations.damaged(empty), "dropped").collect() == []
    assert conversations.repaired(empty).collect() == []
