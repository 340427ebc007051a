"""URL rules, mixing, line dedup: edge cases and rules, next to plain Python."""

from collections import defaultdict

from cloakstone.llm import line_runs, mixing, url_filter


def rules(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def judged(spark, urls, rows):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, rules(spark, rows)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def plain(url, rows):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [
        (len(h + (p or "")), len(h), v == "block", h + (p or ""), v)
        for h, p, v in rows
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_url_rules_longest_wins(spark):
    rows = [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/a/", "allow"), ("example.org", "", "block"),
        ("a.example.org", "/", "block"), ("com", "/x", "block"), ("com", "/x", "allow"), ("com", "/x/y", "allow"), (None, "/", "block"),
        ("co", None, "block"),
    ]
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/es/1?q=/es/a/", "https://b.a.example.org/es/a/b#x",
        "http://notexample.org/es/", "http://x.com/x/yz", "http://x.com/x", "http://x.com/X", "http://com/x/y/z", "http://co?a/b",
        "ftp://u.co/x://org/", "http://example.org./es/", "http://.org/", "http://a..org/z", "http://" + "a." * 3000 + "org/p" + "q" * 5000,
        "http://example.org/es/", "http://example.org/es/", "http://x.com/xé/\x7f",
    ]
    got = judged(spark, urls, rows)
    for i, url in enumerate(urls):
        assert got[i] == plain(url, rows), url


def test_url_rules_many_nested(spark):
    rows = [("h.net", "/" + "/".join("abcdefgh"[:k]), "allow" if k % 2 else "block") for k in range(9)]
    rows += [(f"s{i}.net", f"/{j}", "block") for i in range(30) for j in range(20)]
    urls = [f"http://h.net/{'/'.join('abcdefgh'[:k])}{t}" for k in range(9) for t in ("", "/", "zz", "/zz")]
    urls += [f"http://w.s{i}.net/{j}{t}" for i in range(30) for j in range(0, 20, 7) for t in ("", "5")]
    got = judged(spark, urls, rows)
    assert all(got[i] == plain(u, rows) for i, u in enumerate(urls))


def test_url_rules_empty_tables(spark):
    assert judged(spark, [], [("org", "/", "block")]) == {}
    assert judged(spark, ["http://a.org/"], []) == {0: ("a.org", "/", None, "allow")}


MIXED = "doc_id long, source string, text string, target string, copies int, copy int"


def test_mixing_targets(spark):
    docs = [(i, s, "w " * n, "t", 1, 2) for i, (s, n) in enumerate([("b", 10), ("a", 1000), ("b", 30), (None, 400), ("é", 7), ("z", 0)])]
    docs += [(7, "a", None, None, None, None), (None, None, "x y", None, None, None), (8, "", "", "", 0, 0)]
    frame = spark.createDataFrame(docs, MIXED)
    plan = mixing.mix_plan(frame)
    rows = plan.collect()
    assert len(rows) == len(docs)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    size = {s: n for s, (n, _) in targets.items()}
    assert size == {"": 0, "a": 1000, "b": 40, "z": 0, "é": 7, None: 402}
    weight = dict(zip(["", "a", "b", "z", "é", None], [5, 2, 1, 5, 2, 1], strict=True))
    left, held = set(size), {}
    while True:
        level = (1.5 * sum(size.values()) - sum(held.values())) / max(1, sum(weight[s] for s in left))
        over = {s for s in left if 2 * size[s] < level * weight[s]}
        if not over:
            break
        held |= {s: 2.0 * size[s] for s in over}
        left -= over
    assert {s: t for s, (_, t) in targets.items()} == {s: held.get(s, level * weight[s]) for s in size}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    again = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.mix_plan(frame.repartition(3)).collect()}
    assert all(again[r["doc_id"], r["source"]] == r["taken"] for r in rows)
    mixed = mixing.mix(frame)
    assert mixed.columns == [*frame.columns, "copy_"]
    emitted = defaultdict(int)
    for r in mixed.collect():
        emitted[r["doc_id"], r["source"]] += 1
    assert emitted == {(r["doc_id"], r["source"]): r["copies"] for r in rows if r["copies"]}


def test_mixing_meets_targets_and_empty(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) AS source", "repeat('w ', 5 + cast(id % 40 as int)) AS text")
    for row in mixing.mix_plan(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(row["sum(taken)"] - row["max(target)"]) < 0.1 * row["max(target)"]
    empty = spark.createDataFrame([], MIXED)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


LINED = "doc_id long, text string, at int, key string, batch int, keeper string"


def plain_lines(docs):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 20 and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in docs:
        pieces = (text or "").split("\n")
        stay = []
        for line in pieces:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            ids = holders.get(key, set()) if len(key) >= 20 and doc_id is not None else set()
            if len(ids) < 3 or max(ids) == doc_id:
                stay.append(line)
        out.append((doc_id, len(pieces), len(pieces) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    common = "This line stands in many documents."
    docs = [
        (1, f"{common}\nown text one"), (2, f"own\n  {common.upper()}\t\n{common}"), (3, common), (4, f"x\n{common}\n{common}\ny"),
        (5, None), (6, ""), (7, "\n"), (8, "short line\n" * 5), (9, "short line"), (10, "short line"), (3, common),
        (None, common), (11, "Éé" * 9 + "É\n" + "abcdefghijklmnopqrst"), (12, "éé" * 9 + "é\nABCDEFGHIJKLMNOPQRST"),
        (13, "Éé" * 9 + "É\nabcdefghijklmnopqrst"), (14, ("long line of words " * 3 + "\n") * 3000), (15, "\x0b" + common + "\x0c"),
    ]
    frame = spark.createDataFrame([(d, t, 1, "k", 2, "z") for d, t in docs], LINED)
    cleaned = line_runs.dedup_lines(frame)
    assert cleaned.columns == [*frame.columns, "__n_lines", "__n_dropped"]
    got = sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"] or "") for r in cleaned.collect()), key=repr)
    assert got == plain_lines(docs)


def test_line_dedup_empty(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], LINED)).count() == 0


def test_runs_compact_by_level(spark):
    lines = spark.createDataFrame([(d, 0, 0, bytes([k]), 0) for d in range(8) for k in (1, 2 + d)], "doc_id long, row long, at int, key binary, batch int")
    runs = line_runs.LineRuns(spark, fanout=2, buckets=2)
    for d in range(7):
        runs.add(lines.filter(f"doc_id = {d}"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    plan = runs._pair(runs.levels[2][0], runs.levels[1][0])._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    total = {bytes(r["key"]): (r["n_docs"], r["keeper"]) for r in runs.compacted().collect()}
    assert total == {bytes([1]): (7, 6)} | {bytes([2 + d]): (1, d) for d in range(7)}
    assert [len(level) for level in runs.levels] == [0, 0, 1]
