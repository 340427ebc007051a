from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakstone.operators import values as v


def frames(spark, texts, words):
    return (
        spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3),
        spark.createDataFrame([(w,) for w in words], "value string"),
    )


def brute(texts, words):
    return sorted((i, w, t.count(w)) for i, t in enumerate(texts) for w in set(words) if len(w) >= 5 and w in t)


def pairs(spark, texts, words, **options):
    found = v.containment_pairs(*[frames(spark, texts, words)[0], "id", "text", frames(spark, texts, words)[1]], **options)
    return sorted((r["id"], r["value"], r["occurrences"]) for r in found.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abé😀-") for _ in range(rng.randrange(5, 12))) for _ in range(400)]
    words += ["aaaaa", "aaaaaa", "abababa", "short"[:4], "x" * 40]
    texts = []
    for _ in range(120):
        body = "".join(rng.choice("abé😀-") for _ in range(rng.randrange(0, 400)))
        texts.append(body + rng.choice(words) * rng.randrange(0, 3))
    return texts + ["", "aaaaaaaaaaaaaaa", "abababababab", "x" * 200], words


def test_pairs_match_brute_force(spark, corpus):
    assert pairs(spark, *corpus) == brute(*corpus)


def test_tiny_filter_stays_exact(spark, corpus):
    assert pairs(spark, *corpus, bits=1 << 10, salts=4) == brute(*corpus)


def test_values_longer_than_the_filter_looks_at(spark):
    head = "h" * 70
    words = [head + "x", head + "y" * 300, "ab" * 50, "z" * 64, head]
    texts = ["-" + head + "x" + head + "y" * 299, head + "y" * 301, "ab" * 130, "z" * 200, "", "h" * 69]
    assert pairs(spark, texts, words) == brute(texts, words)


def test_megabyte_value_beside_short_ones(spark):
    rng = random.Random(8)
    story = "".join(rng.choice("abcdé ") for _ in range(1 << 20))
    words = [story, story[:-1] + "#", story[5:9000], story[5:70], "short-one", "w" * 5000, "w" * 4160]
    texts = ["<" + story[:300_000], "<" + story + "> short-one", story[:-1] + "?", "w" * 12_000, "-".join([story[5:9000]] * 3), story + story]
    assert pairs(spark, texts, words) == brute(texts, words)
    rows, dictionary = frames(spark, texts, words)
    found = v.candidates(rows, v.build_filter(dictionary), "id").collect()
    assert len(found) < 30 and sum(len(r["value"]) for r in found) < 30 * 80


@pytest.mark.parametrize("size", [63, 64, 65, 127, 128, 4159, 4160, 4161, 4160 + 4096, 4160 + 4097, 20_000])
def test_lengths_around_the_blocks(spark, size):
    rng = random.Random(size)
    value = "".join(rng.choice("abcd") for _ in range(size))
    for at in {0, 63, 64, size // 2, size - 1} & set(range(size)):
        other = value[:at] + "#" + value[at + 1 :]
        texts = [value + value, "x" + other, "x" + value[:-1], value[:-1] + value, other + value]
        filtered = v.build_filter(spark.createDataFrame([(value,)], "value string").coalesce(1))
        batch = pd.DataFrame({"id": range(len(texts)), "text": texts})
        found = pd.concat([pd.DataFrame({"id": [], "occurrences": []}), *v.scanner(filtered, "id")(iter([batch]))])
        assert dict(zip(found["id"], found["occurrences"], strict=True)) == {i: t.count(value) for i, t in enumerate(texts) if value in t}


def test_few_suspects_are_gated_before_python(spark):
    corpus = spark.createDataFrame([(i, f"row {i} of nothing") for i in range(50)] + [(50, "has 900-11-2222 twice 900-11-2222")], "id int, line string")
    suspects = spark.createDataFrame([("900-11-2222",), ("900-99-9999",)], "candidate string")
    settled = v.adjudicate(suspects, corpus, "id", "line")
    assert sorted((r["occurrences"], r["leaked"]) for r in settled.collect()) == [(0, False), (2, True)]
    assert v.adjudicate(suspects.where("false"), corpus, "id", "line").count() == 0
    assert "900-11-2222" not in settled._jdf.queryExecution().toString()


def test_thousands_of_short_strings(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefghijklmnop0123456789é") for _ in range(rng.randint(1, 4))) for _ in range(6000)}
    corpus = ["".join(rng.choice("abcdefgh0123é,") for _ in range(300)) for _ in range(20)] + ["aaaa"]
    rows = v.adjudicate(
        spark.createDataFrame([(w,) for w in words], "candidate string"),
        spark.createDataFrame([("same", t) for t in corpus], "id string, line string"), "id", "line",
    ).collect()
    assert len(rows) == len(words) > 3000
    assert sum(r["occurrences"] for r in rows) == sum(t.count(w) for t in corpus for w in words)


def test_text_longer_than_a_block(spark):
    rng = random.Random(9)
    body = [rng.choice("abc ") for _ in range(3 * v.BLOCK + 17)]
    for at in (0, v.BLOCK - 3, v.BLOCK, 2 * v.BLOCK - 9, len(body) - 12):
        body[at : at + 12] = "NEEDLE-00042"
    text = "".join(body)
    assert pairs(spark, [text, "none"], ["NEEDLE-00042", "NEEDLE-00043", "abcab"]) == brute(
        [text, "none"], ["NEEDLE-00042", "NEEDLE-00043", "abcab"]
    )


def test_hot_value(spark):
    texts = [f"row {i} HOTVALUE here" if i % 3 else f"row {i} quiet" for i in range(900)]
    words = ["HOTVALUE", *[f"cold-{i:05d}" for i in range(500)]]
    assert pairs(spark, texts, words) == brute(texts, words)
    found = v.occurring_values(*[frames(spark, texts, words)[0], "id", "text", frames(spark, texts, words)[1]])
    assert [tuple(r) for r in found.collect()] == [("HOTVALUE", 600)]


@pytest.fixture()
def people(frame):
    return frame(
        patient_name=["Ada Lovelace", " Ada Lovelace ", "Jo", "Grace Hopper"],
        subject_id=["STUDY-0001", "STUDY-0002", "STUDY-0003", "STUDY-0004"], arm=["t", "p", "t", "p"],
    )


def scan(spark, text, people, columns):
    texts = spark.createDataFrame([(0, t) for t in text], "id int, text string")
    out = v.value_scan(texts, "id", "text", people, columns)
    return out, {r["column"]: (r["values_compared"], r["distinct_values_found"]) for r in out.collect()}


def test_counts_per_column(spark, people):
    columns = ["patient_name", "subject_id", "arm", "unknown"]
    _, found = scan(spark, ["met Ada Lovelace", "saw STUDY-0004, STUDY-00"], people, columns)
    # padded and bare spellings are two values as written; values under five characters are skipped
    assert found == {"patient_name": (3, 2), "subject_id": (4, 1)}


def test_clean_text_and_short_values(spark, people):
    out, found = scan(spark, ["Jo met t and p"], people, ["patient_name", "subject_id"])
    assert found == {"patient_name": (3, 0), "subject_id": (4, 0)}
    assert v.assert_complete(v.scan_summary(out, ["patient_name", "subject_id"]))["leaked"] is False


def test_a_scan_that_compared_nothing_is_an_error(spark, people):
    for columns in (["unknown"], ["arm"], []):
        out, _ = scan(spark, ["text"], people, columns)
        with pytest.raises(v.ScanIncomplete):
            v.assert_complete(v.scan_summary(out, columns))


def test_adjudication(spark):
    corpus = spark.createDataFrame([(0, "a,900-11-2222,b"), (1, "900-33-4444 900-33-4444"), (2, "x")], "id int, line string")
    suspects = spark.createDataFrame([("900-11-2222",), ("900-33-4444",), ("900-55-6666",), ("a,9",), ("",)], "candidate string")
    rows = v.adjudicate(suspects, corpus, "id", "line").collect()
    by_print = {r["fingerprint"]: (r["occurrences"], r["leaked"]) for r in rows}
    prints = suspects.select("candidate", F.substring(F.sha2("candidate", 256), 1, 12).alias("p")).collect()
    named = {r["candidate"]: by_print.get(r["p"]) for r in prints}
    assert named == {"900-11-2222": (1, True), "900-33-4444": (2, True), "900-55-6666": (0, False), "a,9": (1, True), "": None}
    assert "900" not in str([r["fingerprint"] for r in rows if r["fingerprint"].startswith("900-")])


def test_candidate_list_and_corpus_sources(spark, tmp_path):
    from cloakstone.sources.canary import read_candidates
    from cloakstone.sources.tables import read_corpus

    (tmp_path / "c.json").write_text('["900-11-2222", "900-33-4444", "900-11-2222"]')
    listed = read_candidates(spark, str(tmp_path / "c.json"))
    assert sorted(r["candidate"] for r in listed.collect()) == ["900-11-2222", "900-33-4444"]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="JSON array of strings"):
        read_candidates(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "lines.json").write_text('["a", "b"]\n["b", "", "c"]\n')
    assert {r["candidate"] for r in read_candidates(spark, str(tmp_path / "lines.json"), lines=True).collect()} == {"a", "b", "c"}
    (tmp_path / "lines-bad.json").write_text('["a"]\nnot json\n')
    with pytest.raises(Exception, match="JSON array"):
        read_candidates(spark, str(tmp_path / "lines-bad.json"), lines=True).collect()
    (tmp_path / "a.csv").write_bytes(b"x,900-11-2222\n\xff\xfe broken 900-33-4444\n")
    lines, read = read_corpus(spark, [str(tmp_path / "a.csv"), str(tmp_path / "absent.csv")])
    assert read == [str(tmp_path / "a.csv")]
    settled = v.adjudicate(listed, lines, "source", "line")
    assert sorted(r["occurrences"] for r in settled.collect()) == [1, 1]


def test_trial_values_in_documents_match_brute_force(spark, trial):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    planted = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" STUDY-0000041 p41@example.com"))).otherwise(F.col("text")))
    columns = ["subject_id", "email", "mrn", "patient_name"]
    got = {r["column"]: r["distinct_values_found"] for r in v.value_scan(planted, "doc_id", "text", trial, columns).collect()}
    whole = "\n".join(r["text"] for r in planted.select("text").collect())
    rows = trial.select(*columns).distinct().collect()
    want = {c: sum(len(x.strip()) >= 5 and x.strip() in whole for x in {r[c] for r in rows}) for c in columns}
    assert got == want and want["subject_id"] == 1


def test_the_cells_are_derived_once_and_copies_change_nothing(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Orla Hartwell met Bram Osei"), (2, "Orla Hartwell")], "id int, text string")
    table = spark.createDataFrame([("Orla Hartwell", " Bram Osei"), ("Orla Hartwell", "Bram Osei"), ("nobody here", None)] * 2, "name string, other string")
    derived, compared = [], v.compared_cells
    monkeypatch.setattr(v, "compared_cells", lambda *given, **options: derived.append(options) or compared(*given, **options))
    rows = {r["column"]: (r["values_compared"], r["distinct_values_found"]) for r in v.value_scan(texts, "id", "text", table, ["name", "other"]).collect()}
    assert rows == {"name": (2, 1), "other": (2, 2)} and derived == [{"distinct": True}]
    twice = compared(table, ["name", "other"]).select("value")
    pairs = v.containment_pairs(texts, "id", "text", twice).collect()
    assert sorted(tuple(r) for r in pairs) == [(1, "Bram Osei", 1), (1, "Orla Hartwell", 1), (2, "Orla Hartwell", 1)]


def test_settling_takes_a_dictionary_with_copies(spark):
    hits = spark.createDataFrame([(1, "Bram Osei", 2), (2, "no value", 1)], "id int, value string, occurrences long")
    known = spark.createDataFrame([("Bram Osei",), ("Bram Osei",), ("unseen",)], "value string")
    assert [tuple(r) for r in v.settle(hits, "id", known).collect()] == [(1, "Bram Osei", 2)]
