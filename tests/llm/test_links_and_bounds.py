"""Links of rows without an id, license notices down to the bound of coverage, markup that never ends."""

import random
import re
import time

import pytest

from keyloom.llm import dom, embeddings, html_text, licenses, minhash

duckdb = pytest.importorskip("duckdb")


def beside_sql(rows, sql, table, tmp_path):
    path = str(tmp_path / f"{table}.parquet")
    rows.toPandas().to_parquet(path)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{path}')")
    return c.execute(sql).fetchall()


def test_a_text_without_an_id_links_its_neighbours(spark, tmp_path):
    words = [f"w{i}" for i in range(63)]
    texts = [" ".join(w) for w in (words[:51], words[6:57], words[12:])]  # neighbours are alike by 0.76, the ends by 0.6
    rows = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (3, texts[2]), (None, "alone and with no id at all"), (7, None)], "doc_id long, text string")
    got = minhash.near_duplicates(rows).collect()
    at = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert at[1]["component_id"] == at[3]["component_id"] == 1 and at[1]["kept"] and not at[3]["kept"] and at[7]["component_id"] == 7
    assert sorted((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None and r["component_id"]) == [(1, False)]
    assert [r["kept"] for r in got if r["component_id"] is None] == [True]
    wanted = beside_sql(rows.withColumn("doc_id", rows.doc_id.cast("long")), minhash.OP7_SQL, "documents", tmp_path)
    clean = lambda x: None if x is None or x != x else int(x)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got))) == sorted(str((clean(a), b, clean(c), d)) for a, b, c, d in wanted)


def test_a_vector_without_an_id_links_its_neighbours(spark, tmp_path):
    import math

    v = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    rows = spark.createDataFrame([(1, v(0)), (None, v(20)), (3, v(40)), (None, v(20)), (None, [0.0, 0.0, 5.0]), (9, None), (10, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(rows).collect()
    wanted = beside_sql(rows, embeddings.OP2_SQL, "embeddings", tmp_path)
    clean = lambda x: None if x is None or x != x else int(x)
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got))) == sorted(str((clean(a), b, clean(c), d)) for a, b, c, d in wanted)
    at = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert (at[1]["n_links"], at[3]["n_links"], at[3]["component_id"]) == (2, 2, 1)


@pytest.mark.parametrize("name", licenses.TEMPLATES)
@pytest.mark.parametrize("once_first", [True, False])
def test_a_license_is_found_down_to_the_bound(name, once_first):
    """Words taken out of a template until its coverage is just at the bound, words that occur once first or any; the first word stays."""
    library = licenses.Library.of()
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", licenses.TEMPLATES[name].translate({i: i + 32 for i in range(65, 91)}))
    r = random.Random(name)
    for share in (0.9, licenses.COVERAGE):
        out = list(range(1, len(words)))
        r.shuffle(out)
        if once_first:
            out.sort(key=lambda i: words.count(words[i]) > 1)
        gone = set(out[: int((1 - share) * len(words) + 1e-9)])
        text = "before it " + " ".join(w for i, w in enumerate(words) if i not in gone) + " and after"
        import pyarrow as pa

        found = library.scan(pa.array([text]))[0]
        same = [m for m in found if m[0] == name]
        others = [m for m in found if m[0] != name]
        assert same and same[0][1] >= licenses.COVERAGE or others, (name, share, found)  # or a template that holds it, or is alike, covers more
        if same:
            assert same[0][1] == pytest.approx((len(words) - len(gone)) / len(words), abs=0.02)


def test_markup_without_an_end_is_read_once():
    for s in ("<a" * 500_000, "<svg>" + "</svg" * 200_000, "<script>" + "</script" * 120_000, "<a '" * 250_000, "<a b=\"'" * 100_000, "</a" * 300_000, "<template>" * 90_000):
        began = time.process_time()
        dom.parse(s)
        assert time.process_time() - began < 5, s[:10]


def read(s):
    page = dom.parse(s)
    return dom.text_of(page, [True] * len(page.tag))


def test_only_scripts_and_styles_swallow():
    assert read("<p>a <svg><text>b</text><svg>c</svg>d</svg> e</p>f") == "a bcd e\nf"
    assert read("<p>a <math><mi>x</mi><mo>+</mo></math> b <noscript>c</noscript><object>d") == "a x+ b cd"
    assert read("<p>a<svg>b</p>c<p>d") == "ab\nc\nd"
    assert read("a<script>b<p>c") == "a" and read("a<style>x</style >b<SCRIPT>y</scriptx></Script\n>c") == "abc"
    assert read("a<template>b<p>c<template>d</template></template>e<iframe>f</iframe>g") == "a\ne\ng"


def test_pages_of_the_tables_give_the_article(spark):
    """The text of the element ``article`` by a plain reading, on pages that have one such element."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.op8_dom_trees(spark, sf).collect()}
    inner = {k: re.findall(r"(?s)<article\b[^>]*>(.*?)</article>", v or "") for k, v in pages.items()}
    one = [k for k, v in inner.items() if len(v) == 1]
    plain = {k: read(re.sub(r"(?s)<(aside|nav|footer|header|form|figure)\b.*?</\1>", "", inner[k][0])) for k in one}
    same = sum(set(plain[k].split("\n")) >= set(got[k].split("\n")) - {""} and got[k] != "" for k in one)
    assert set(got) == set(pages) and len(one) > 0 and same >= 0.95 * len(one)
