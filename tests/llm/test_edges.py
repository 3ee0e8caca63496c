"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from keyloom.llm import decontaminate, embeddings, html_text, licenses, line_chunks, minhash, mixing, preferences, sharding, toxicity

LONG = " ".join(f"word{i % 9973}" for i in range(120_000))
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10),
    (2, "The QUICK brown fox jumps over the lazy dog and runs away from here", None, "b", None),
    (3, None, "en", None, 0),
    (4, "", "en", None, 0),
    (5, " \t\n\r ", "en", "c", 5),
    (6, "one two", "en", "c", 5),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG, "en", "a", len(LONG)),
    (None, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10),
    (None, None, None, None, None),
    (9, "All rights reserved.\nline\n\nline two Ünïcödé ﬁ ​", "de", "d", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make or use inside, as strings.
CLASHES = ["score", "n_words", "matches", "licenses", "shard", "virtual_slot", "map_version", "rep", "key", "size", "sid", "bucket", "rid", "hi", "lo", "kept", "component", "lane", "taken"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in DOCS], SCHEMA + "".join(f", {c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 1, 1), (None, 1, 1), (6, 0, 5), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (None, "one two"), (4, "!!")], "item_id long, text string")


def test_toxicity(spark, docs, wide, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(wide, model).columns.count("score") == 1
    assert toxicity.keep_clean(wide, model).columns == wide.columns
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.1]), (9, None), (8, []), (7, [0.0, 0.0]), (6, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (None, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, bucket string")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(-1, 5, 2, False), (1, 0, 1, True), (2, 5, 2, True), (3, 5, 2, False), (4, 5, 2, False), (4, 5, 2, False), (5, 5, 2, False), *((k, 0, k, True) for k in (6, 7, 8, 9, 10, 11, 12))]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, "assistant", None), (3, 0, None, None), (3, 1, "user", "x"), (None, 0, "user", "lost"), (4, None, "user", "a"), (4, 0, "assistant", "b" * 100_000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, n_common string")
    got = {r["conv_id"]: r for r in preferences.preference_pairs(preferences.with_spoiled_reply(preferences.conversations(df))).collect()}
    assert set(got) == {1, 2, 4}
    assert got[2]["n_common"] == 1 and got[2]["chosen_completion"] == got[2]["rejected_completion"] == "" and got[2]["prompt"] == "<|assistant|>\n<|end|>\n"
    assert got[1]["prompt"].count("yo") == 2 and got[1]["n_common"] == 3  # the echo of a repeated reply is that reply
    assert len(got[4]["chosen_completion"]) > 100_000 and got[4]["rejected_completion"].endswith("\na<|end|>\n")
    assert preferences.preference_pairs(preferences.with_spoiled_reply(preferences.conversations(df.limit(0)))).count() == 0


def test_line_chunks(spark, docs, wide):
    rows = line_chunks.dedup_lines(wide).collect()
    assert len(rows) == len(DOCS)
    assert {(r["doc_id"], r["text"], r["clean"]) for r in rows} == {(i, t, t) for i, t, *_ in DOCS}  # nothing multi-line repeats
    assert line_chunks.dedup_lines(docs.limit(0)).count() == 0


def test_mixing(spark, docs, wide):
    rows = mixing.mix(wide).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.repeated(wide).columns == wide.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("doc_id in (3, 4)")).count() == 2  # nothing to share


def test_sharding(spark, docs, wide):
    recs = sharding.records(wide)
    out = sharding.numbered(sharding.assign(recs, sharding.fit_map(recs, 3))).collect()
    assert len(out) == len(DOCS)
    for k in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    assert set(sharding.sharded(wide, 3).columns) == set(wide.columns)
    assert sharding.sharded(docs.limit(0), 3).count() == 0


def test_minhash(spark, docs, wide):
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(wide).collect())
    words = LONG.split()
    long = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert got == [(-1, 0, None, True), (-1, 10, 1, False), (1, 10, 1, True), (1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, long, 7, True), (8, long, 7, False), (9, 5, 9, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_html(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<"), (5, "u", "&amp"), (6, "u", "<div class='x" * 50), (7, "u", "<b>" * 3000 + "deep"), (8, "u", "<article><p>" + "word " * 200_000 + "</p></article>"), (8, "u", "<!-- open"), (9, "u", "</p></div>x")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == len(pages) and all(isinstance(r["text"], str) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (1, 2, 3)} == {""}
    assert html_text.extract(df.limit(0)).count() == 0


def test_decontamination(spark, docs, wide, bench):
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.find(wide, bench)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["n_words"]) == (10, 1, 14) and got[2]["n_hit"] == 10
    assert got[6]["n_hit"] == 2 and got[7]["n_hit"] == 0 and got[3]["n_words"] == got[4]["n_words"] == 0
    small = decontaminate.digest(decontaminate.find(docs, bench, block_bytes=40)).select("doc_id", "n_hit", "n_items").collect()
    assert sorted(map(str, small)) == sorted(map(str, decontaminate.digest(decontaminate.find(docs, bench)).select("doc_id", "n_hit", "n_items").collect()))
    assert decontaminate.remove(wide, bench).columns == wide.columns
    assert decontaminate.find(docs, bench.limit(0)).filter("size(matches) > 0").count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_licenses(spark, docs, wide):
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(wide).collect()}
    assert [(m["name"], m["first_word"], m["end_word"]) for m in got[9]] == [("all-rights-reserved", 0, 3)] and not any(got[k] for k in got if k != 9)
    assert licenses.scan(docs.limit(0)).count() == 0
