"""Quality model and rules, extraction, chunks, decontamination, near-dedup, scoring: edge cases and brute force."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakstone.llm import attention_lm, chunks, decontaminate, html_cut, minhash, quality_model, quality_rules
from cloakstone.llm import kernels as K

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, n_words int, node string, digest string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "\n", " \t", "a", "a b", "a\n\na\na", "é " * 30, "x" * 300_000, "long text of words. " * 20_000, "\x00 \x1f\x85　b"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "n", "d", "s") for i, t in rows], DOCS)


def words(text):
    return WORD.findall(text or "")


# --- quality -------------------------------------------------------------------------------------


def test_rules_base_measures(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, "one two three four five six seven eight " * 9])] + [(0, None), (None, "b b b")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(100).collect()]
    got = frame(spark, rows).select("doc_id", "text", quality_rules.judge_text(F.col("text")).alias("j"))
    for r in got.collect():
        text, w = r["text"] or "", words(r["text"])
        seen, again = set(), 0
        for line in text.split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen |= {line}
        window = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if window[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        j = r["j"]
        assert (j["n_words"], j["word_chars"]) == (len(w), sum(map(len, w)))
        assert j["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and j["n_dup_lines"] == again
        assert j["n_repeat_words"] == len(covered)
        assert j["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (j["kept"] and j["base_failed"])


def test_rules_clean_by_line(spark):
    good = "This is a proper sentence that ends the way it should, with a full stop.\n"
    menu, licence = "Home | News | Sport | Contact | About", "Licensed under the Some License, Version 2.0."
    distinct = good + "".join(f"{' '.join(w + str(n) for w in 'abcdefgh')} is said here.\n" for n in range(6))
    docs = frame(spark, [(1, distinct + menu + "\n" + licence), (2, "\n".join([menu] * 9)), (3, distinct)])
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean_documents(docs).collect()}
    assert got == {1: distinct[:-1], 3: distinct}
    assert quality_rules.clean_documents(docs).columns == docs.columns
    assert quality_rules.clean_documents(frame(spark, [])).count() == 0


def test_quality_model_learns(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) > 30


def test_quality_model_edges(spark):
    docs = frame(spark, [*enumerate(ODD), (None, "text"), (3, " \t")])
    labels = spark.createDataFrame([(4, 1, "q"), (4, 0, "q"), (5, None, "q"), (None, 1, "q"), (6, 1, "q"), (7, 1, "q")], "doc_id long, quality int, score string")
    for marks in (labels, labels.filter("false")):
        rows = quality_model.score_documents(docs, marks).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
        assert quality_model.keep_good(docs, marks).columns == docs.columns
    assert {r["score"] for r in rows} == {0.5}
    assert quality_model.score_documents(frame(spark, []), labels).count() == 0


def test_trees_traverse_as_written():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality_model.fit(x, y, trees=30, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], trees.score(x[:20]), strict=True):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))


# --- pages ---------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 8)
        lean = [random.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(n)]
        edges = [(a, b, random.choice([0.3, 1.5])) for a, b in itertools.combinations(range(n), 2) if random.random() < 0.4]

        def cost(labels, lean=lean, edges=edges):
            wrong = sum(abs(s) for s, x in zip(lean, labels, strict=True) if x != (s > 0))
            return wrong + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert math.isclose(cost(html_cut.minimum_cut(lean, edges)), best, abs_tol=1e-9)


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top of site</header><nav><a href=x>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies on this site, please accept them all.</div><article><h1>Head &amp; tail</h1>"
        "<p>First  paragraph\n of the <b>text</b>, long enough to be read.<br>Same block.</p><p>Short.</p><p>Unclosed one is "
        "content too.<p>Last &quot;one&quot; here.</article><section class='comments'><p>Nice article, I read it twice.</p></section>"
        "<form>Your name<input></form><aside>Other things to read on this site today.</aside><script>var x='<p>no</p>';</script>"
        "<div class=ad>Buy this now, it is very cheap.</div><footer>&copy; Me</footer>"
    )
    want = 'Head & tail\nFirst paragraph of the text, long enough to be read. Same block.\nShort.\nUnclosed one is content too.\nLast "one" here.'
    odd = [None, "", "<", "<p", "<!-- x", "<script>y", "&amp", "<nav><ul><li>a<article><p>Text after an open menu, it is content.", "<div>" * 3000]
    rows = [(i, "u", h, "t", 5) for i, h in enumerate([page, page, *odd])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_cut.extract(pages).collect()}
    assert got[0] == got[1] == (want, len(want))
    assert [got[i + 2][0] for i in range(6)] == [""] * 6 and got[9][0] == "Text after an open menu, it is content."
    assert html_cut.extract(pages.filter("false")).count() == 0


# --- substring dedup -----------------------------------------------------------------------------


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ,.") for _ in range(20_000)).encode()
    data, at = np.frombuffer(text + b"zz" + text, np.uint8), np.array([0, 20_000, 20_000, 40_002])
    starts, ends, of = chunks.chunks_of(data, at, 24)
    for i in (0, 2):
        mine = of == i
        assert starts[mine][0] == at[i] and ends[mine][-1] == at[i + 1] and (starts[mine][1:] == ends[mine][:-1]).all()
    assert not (of == 1).any() and (ends - starts).max() <= chunks.LARGEST
    first, second = ({text_of(data, s, e) for s, e, o in zip(starts, ends, of, strict=True) if o == i} for i in (0, 2))
    assert len(first & second) > 0.97 * len(first)
    hashes = chunks.gear_hashes(data)
    slow = 0
    for i, byte in enumerate(data[:100]):
        slow = (2 * slow + int(chunks.GEAR[byte])) % 2**32
        assert slow == hashes[i]


def text_of(data, start, end):
    return data[start:end].tobytes()


def test_repeated_spans(spark):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(n))

    passage, line = prose(70), prose(15)
    docs = [(1, prose(200) + " " + passage + " " + prose(100)), (2, passage), (3, prose(300)), (4, prose(50) + "\n" + line), (5, line + "\n" + prose(80))]
    docs += [(6, prose(60) + passage), (7, None), (8, ""), (None, passage), (9, prose(90)), (9, None), (10, "é" * 4000)]
    spans = {r["doc_id"]: r.asDict() for r in chunks.repeated_spans(frame(spark, docs)).collect()}
    assert set(spans) == {1, 2, 6}
    for d, text in docs:
        if d in spans:
            cut = text.encode()[spans[d]["start_byte"] : spans[d]["end_byte"]].decode()
            assert len(words(cut)) >= 40 and len(set(words(cut)) - set(words(passage))) <= 12 and spans[d]["first_doc"] == 1
    left = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(frame(spark, docs)).collect()}
    assert left[1] == docs[0][1] and len(words(left[2])) < 25 and left[3] == docs[2][1] and left[7] is None
    assert chunks.repeated_spans(frame(spark, [])).count() == 0


def test_partial_quotes_stay_in_one_document(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmé") for _ in range(rng.randint(2, 9))) for _ in range(n))

    half, rest = prose(60), prose(60)
    quoted = half + " " + rest
    docs = [(2, prose(40) + " " + half + " " + prose(40)), (5, prose(30) + " " + quoted + " " + prose(30)), (9, prose(50) + " " + quoted)]
    texts = dict(docs)
    first = defaultdict(set)
    for r in chunks.repeated_spans(frame(spark, docs)).collect():
        texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()  # between characters
        first[r["doc_id"]].add(r["first_doc"])
    assert first == {2: {2}, 5: {2, 5}, 9: {2, 5}}
    left = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(frame(spark, docs)).collect()}
    assert left[2] == texts[2] and rest[-200:] in left[5] and len(left[9]) < len(texts[9]) - 500
    kept = "\n".join(left.values())
    assert all(any(w in t.split() for t in left.values()) for w in quoted.split()), kept


# --- decontamination -----------------------------------------------------------------------------


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_short_items_survive_every_edit(spark):
    """Items of every length from 12 to 64, substituted, cut or doubled at every position, twice where allowed."""
    rng = random.Random(11)
    items, docs, of = [], [], []
    for n in range(12, 65):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        items.append((n, item))
        for at in range(n):
            for put in ("7", "", item[at] * 2):
                text = item[:at] + put + item[at + 1 :]
                docs.append((len(docs), text if rng.random() < 0.5 else "one " + text + " two"))
                of.append(n)
                if n >= 32:
                    other = rng.randrange(len(text))
                    docs.append((len(docs), text[:other] + "8" + text[other + 1 :]))
                    of.append(n)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), bench, min_chars=12)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    # Items of random letters are in no document but their own.
    own = {d: decontaminate.distance(dict(items)[n].encode(), t.encode(), n // 16)[0] for (d, t), n in zip(docs, of, strict=True)}
    want = {(d, n): own[d] for d, n in enumerate(of) if own[d] >= 0}
    assert got == want and len(want) > 5000


def test_items_too_short_for_edits_are_found_as_whole_words(spark):
    rng = random.Random(12)
    items = [(0, "A"), (1, "ab"), (2, "abc"), (3, "a b"), (4, "abc, abc"), (5, "\u00e9"), (6, "ab-ba ab ba ab ba"), (7, "..."), (8, "abcab abcab abcabcd"), (9, "ab")]
    docs = [(d, rng.choice(["", " ", "("]) + rng.choice(" -.").join(rng.choice(["a", "AB", "abc", "abcab", "b", "ba", "\u00e9", "abcabcd"]) for _ in range(rng.randint(0, 12)))) for d in range(300)]
    docs += [(300, "abcab abcab abcabcd"), (301, "xabcab abcab abcabcd"), (302, ""), (303, None), (304, "a" * 5000), (305, "ab " * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), bench).collect()
    form = {i: decontaminate.normal(t.encode()) for i, t in items}
    want = {(d, i) for d, t in docs for i, item in form.items() if item and b" " + item + b" " in b" " + decontaminate.normal((t or "").encode()) + b" "}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 500
    assert all(r["distance"] == 0 and r["item_bytes"] == len(form[r["item_id"]]) for r in found)
    assert (300, 8) in want and (301, 8) not in want


def test_edit_distance_against_table():
    rng = random.Random(3)
    for _ in range(400):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        assert decontaminate.distance(item, text, 99)[0] == least_edits(item, text)


def test_contaminated_against_table(spark):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(n))

    items = [(i, prose(rng.randint(6, 40)).capitalize() + ".", "x") for i in range(12)] + [(12, None, "x"), (13, "tiny", "x"), (14, "", "x")]
    items.append((15, items[0][1], "x"))
    docs = []
    for d in range(60):
        body = list(items[d % 12][1].replace(" ", "  ").upper() if d % 5 == 0 else items[d % 12][1])
        for _ in range(d % 9):
            body[rng.randrange(len(body))] = rng.choice(["", "z", "qq"])
        docs.append((d, prose(rng.randint(0, 50)) + ", " + "".join(body) + "\n" + prose(rng.randint(0, 50)) if d % 4 else prose(60)))
    docs += [(60, None), (61, ""), (None, items[1][1]), (62, "é" * 50), (1, docs[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    want = {}
    for (d, text), (i, item, _) in itertools.product(docs, items):
        a, b = decontaminate.normal((item or "").encode()), decontaminate.normal((text or "").encode())
        if d is not None and len(a) >= 20 and (best := least_edits(a, b)) <= len(a) // 16:
            want[d, i] = best
    assert got == want and len(want) > 25
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, docs), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})
    nothing = decontaminate.contaminated(frame(spark, []), bench)
    assert nothing.count() == 0 and decontaminate.contaminated(frame(spark, docs), bench.filter("false")).count() == 0


# --- near duplicates -----------------------------------------------------------------------------


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_components(docs, width, percent):
    sets = defaultdict(list)
    for d, t in docs:
        if d is not None and shingles(t, width):
            sets[d].append(shingles(t, width))
    parent = {d: d for d, _ in docs if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_exact(spark, monkeypatch, width, percent):
    rng = random.Random(width)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)  # several blocks in a small cluster
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(rng.choice([1, 2, 7, 30, 90]))] for _ in range(40)]
    docs = []
    for d in range(160):
        body = list(base[0] if d % 3 == 0 else base[d % 40])
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = f"new{rng.randint(0, 5)}"
        docs.append((1000 - d, " ".join(body).upper() if d % 7 == 0 else "\n".join(body)))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, docs[0][1]), docs[5], (2003, "one"), (2004, "ONE"), (2005, "x" * 200_000)]
    rows = minhash.near_duplicates(frame(spark, docs), width, percent).collect()
    want = plain_components(docs, width, percent)
    assert len(rows) == len(docs) and len(set(want.values())) < len(want) - 30
    for r in rows:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    size = {d: len(shingles(t, width)) for d, t in docs}
    assert all(r["n_shingles"] == size[r["doc_id"]] for r in rows)
    left = minhash.drop_near_duplicates(frame(spark, docs), width=width, percent=percent)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if want.get(d) == d)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_densified_signature_estimates():
    rng = np.random.default_rng(6)
    pool = np.unique(K.mix(rng.integers(1, 1 << 60, 4000).astype(np.uint64)))
    same = minhash.signatures([np.sort(pool[:20]), np.sort(pool[:20])])
    assert (same[0] == same[1]).all()
    a, b = minhash.signatures([np.sort(pool[:3000]), np.sort(pool[600:3600])])
    assert abs((a == b).mean() - 2400 / 3600) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (300, 100), (300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}


# --- language model ------------------------------------------------------------------------------


def test_html_heads_and_landmarks_of_the_page_are_left_out():
    body = "".join(f"<p>This is sentence {i} of the article, and it has enough words to count as text.</p>" for i in range(6))
    talk = "<p>The best news of the day, every day, from people who know what they write about.</p>"
    head = f"<header><h1>Daily Site</h1>{talk}</header>"
    sides = "".join(f"<div role={role}>{talk}{talk}</div>" for role in ("contentinfo", "'complementary'", '"navigation menu"', "BANNER"))
    want = html_cut.main_text(f"<body><article>{body}</article></body>")
    assert want.count("\n") == 5
    for page in (f"{head}<article>{body}</article>{sides}", f"{sides}{head}<main>{body}</main>", f"{sides}<div role=main>{body}</div>{head}"):
        assert html_cut.main_text(f"<html><body>{page}</body></html>") == want
    own = html_cut.main_text(f"<article><header><h1>The title of it</h1></header>{body}</article>")
    assert own == "The title of it\n" + want


def test_chunks_of_one_id_with_several_texts(spark):
    rng = np.random.default_rng(11)

    def text(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))

    passage, more, other = text(120), text(60), text(300)
    docs = [(1, passage), (2, f"{passage} {more}"), (2, other), (2, other), (3, other[:200])]
    left = [(r["doc_id"], r["text"]) for r in chunks.drop_repeats(frame(spark, docs)).collect()]
    assert sorted(left).count((2, other)) == 2  # an unrelated text of the same id stays whole
    assert (1, passage) in left
    (cut,) = [t for d, t in left if d == 2 and t != other]
    assert len(cut) < len(more) + 300 and cut.endswith(more[-300:])
    spans = [r.asDict() for r in chunks.repeated_spans(frame(spark, docs)).collect()]
    assert {(s["doc_id"], s["first_doc"]) for s in spans if s["end_byte"] > 300} == {(1, 1), (2, 1)}


def test_lm_base_and_model(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, " \t"), (50, "The the THE cat")]
    docs += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    shape = attention_lm.Shape(head=50, learners=2, rounds=1)
    rows = [r.asDict() for r in attention_lm.score_texts(frame(spark, docs), shape).collect()]
    assert len(rows) == len(docs)

    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    count = Counter()
    for d, t in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            count.update(tokens(t))
    total, z = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append(tokens(t))
    for r in rows:
        own = texts[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / z) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert attention_lm.score_texts(frame(spark, []), shape).count() == 0


def test_lm_learns_from_every_id_once(spark):
    shape = attention_lm.Shape()
    texts = {d: np.random.default_rng(d).integers(0, attention_lm.IDS, n).astype(np.uint16) for d, n in enumerate([1, 31, 32, 33, 5000])}
    spelled = spark.createDataFrame([(d, bytearray(t.tobytes())) for d, t in texts.items()], "doc_id long, ids binary")
    parts = defaultdict(list)
    rows = attention_lm.training_windows(spelled, shape).orderBy("doc_id", "at").collect()
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint16)
        assert ids[0] == (texts[r["doc_id"]][r["at"] - 1] if r["at"] else attention_lm.END)
        parts[r["doc_id"]].append(ids[1:])
    assert all((np.concatenate(parts[d]) == t).all() and sum(map(len, parts[d])) == len(t) for d, t in texts.items())
    assert len({r["learner"] for r in rows}) == shape.learners and {r["round"] for r in rows} == set(range(shape.rounds))


def test_lm_is_a_distribution_and_windows_agree():
    shape = attention_lm.Shape(symbols=40, single=20, classes=24, groups=4)
    rng = np.random.default_rng(8)
    model = attention_lm.Model(shape, rng.integers(0, 50, attention_lm.IDS))
    for name in model.w:
        model.w[name] = rng.normal(0, 0.5, model.w[name].shape).astype(np.float32)
    head = rng.integers(0, attention_lm.IDS, 70).astype(np.uint16)
    texts = np.concatenate([np.r_[head, np.uint16(i)] for i in range(attention_lm.IDS)][:2000])
    total = model.score(texts, np.arange(2001) * 71) - model.score(head, np.array([0, 70]))[0]
    every = np.concatenate([np.exp(total)])
    exact = np.exp(model.inside[:2000])
    cls = model.cls[:2000]
    for c in np.unique(cls):  # within a class the shares follow the counts
        mine = every[cls == c] / exact[cls == c]
        assert np.allclose(mine, mine[0], rtol=1e-3)
    shares = {c: (every[cls == c] / exact[cls == c])[0] for c in np.unique(cls)}
    assert sum(shares.values()) <= 1.001
    long = rng.integers(0, 3000, 500).astype(np.uint16)
    assert math.isclose(model.score(long, np.array([0, 500]))[0], model.score(np.r_[head, long], np.array([0, 70, 570]))[1], rel_tol=1e-5)


def test_lm_gradient():
    shape = attention_lm.Shape(symbols=30, single=10, classes=14, groups=7, window=6, stride=4)
    rng = np.random.default_rng(9)
    model = attention_lm.Model(shape, rng.integers(0, 50, attention_lm.IDS))
    model.w = {k: rng.normal(0, 0.5, v.shape) for k, v in model.w.items()}
    x, y = rng.integers(0, 30, (5, 6)), rng.integers(0, 14, (5, 6))
    real = np.ones((5, 6), bool)
    real[0, 3:] = False

    def loss():
        w = model.w
        score = np.where(real[:, None, :], w["q"][x] @ w["k"][x].transpose(0, 2, 1) + model.bias(6), -60.0)
        p = np.exp(score) / np.exp(score).sum(2, keepdims=True)
        z = w["r"][x] + p @ w["v"][x] @ w["o"]
        rows, cols = np.indices(y.shape)
        outer, inner = z @ w["g"] + w["a"], (z @ w["u"] + w["b"]).reshape(5, 6, 7, 2)[rows, cols, y // 2]
        right = outer[rows, cols, y // 2] - np.log(np.exp(outer).sum(2)) + inner[rows, cols, y % 2] - np.log(np.exp(inner).sum(2))
        return -(right * real).sum() / real.sum()

    for name, g in model.step(x, y, real).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-3
        high = loss()
        model.w[name][at] = old - 1e-3
        low = loss()
        model.w[name][at] = old
        assert math.isclose(g[at], (high - low) / 2e-3, rel_tol=2e-2, abs_tol=1e-5), name


def test_kernel_slices_and_words():
    texts = [*ODD, "a" * 50, "b c"]
    data, at = K.buffers(pa.array(texts))
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [t or "" for t in texts]
    found = []
    for piece, offsets in K.slices(data, at, 64):
        begin, end = K.words(piece, offsets)
        of = K.owners(offsets, begin)
        found += [[piece[b:e].tobytes().decode() for b, e in zip(begin[of == i], end[of == i], strict=True)] for i in range(len(offsets) - 1)]
    assert found == [words(t) for t in texts]


def test_lm_learners_are_added_up_in_little_memory():
    shape = attention_lm.Shape()
    model = attention_lm.Model(shape, np.arange(attention_lm.IDS))
    rng, n = np.random.default_rng(11), 60
    uses = rng.integers(0, 3, (n, shape.symbols))
    uses[:, 5] = uses[:, -4000:] = 0
    start = model.inputs()

    def learners():
        for i in range(n):
            model.set_inputs(start + np.float32(i))
            model.w["a"][:] = i
            yield attention_lm._weighted(model, i + 1, uses[i])

    rows = next(learners())
    assert max(len(r.as_buffer()) for r in rows["sums"]) < 8192 and rows.num_rows < shape.symbols / attention_lm.PART
    tracemalloc.start()
    (sums,) = attention_lm._added(learners())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # sums and one learner, not 60 of them
    model.set_inputs(start)
    attention_lm.average(model, {p: np.frombuffer(s, np.float64) for p, s in zip(*sums.to_pydict().values(), strict=True)})
    count = uses.sum(0)
    mean = start + (np.arange(n) @ uses / np.maximum(count, 1))[:, None]
    assert np.allclose(model.inputs()[count > 0], mean[count > 0], atol=1e-3)
    assert (model.inputs()[count == 0] == start[count == 0]).all() and (count == 0).sum() > 4000
    assert np.allclose(model.w["a"], np.arange(n) @ np.arange(1, n + 1) / np.arange(1, n + 1).sum())


def test_lm_workers_forget_words_before_they_train():
    with open(attention_lm.TOKENIZER, "rb") as file:
        model = file.read()
    one = attention_lm.cutter(model, 100)
    assert attention_lm.cutter(model, 100) is one
    attention_lm.forget_words()
    assert not attention_lm._CUTTERS and attention_lm.cutter(model, 100) is not one


def test_lm_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = attention_lm.score_texts(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]
