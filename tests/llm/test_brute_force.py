"""Operators against plain versions of what they promise, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import components, decontaminate, dom, embeddings, html_text, licenses, line_chunks, minhash, mixing, sharding, toxicity

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text, pattern):
    return re.findall(pattern, (text or "").encode().translate(LOWER))


def spaced(text):
    return words_of(text, rb"[^\x20\x09-\x0D]+")


def alnum(text):
    return words_of(text, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def reach(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.fixture(scope="module")
def prose():
    """Random texts, near copies at all distances, chains, and copies that differ in case only."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 90))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append("\n".join(copy) if r.random() < 0.5 else " ".join(copy).upper())
            base = copy if r.random() < 0.5 else base
    return list(enumerate(out, 10))


@pytest.mark.parametrize("side", [512, 6, 2])
def test_minhash(spark, prose, monkeypatch, side):
    """With parts of a few members leaders alone do not find all, and the rest is compared."""
    monkeypatch.setattr(minhash, "SIDE", side)
    monkeypatch.setattr(minhash, "LEADERS", min(32, side // 2))
    monkeypatch.setattr(minhash, "LEAST_MEMBERS", 1 if side < 512 else 8)
    sets = {}
    for i, t in prose:
        w = spaced(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = reach(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(prose, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), low[i], low[i] == i) for i, s in sets.items()} and len(links) > 10


def test_estimate_is_close(prose):
    import pyarrow as pa

    texts = [t for _, t in prose]
    packed = np.frombuffer(minhash._features(pa.array(texts), 5)[4].tobytes(), np.uint64).reshape(len(texts), -1)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := spaced(t)) >= 5 else {tuple(w)} for t in texts]
    errors = [minhash.estimate(packed[i], packed)[j] - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.25


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    low = reach({x for e in edges for x in e}, edges)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame([*edges, (1, None), (7, 7)], "a long, b long")).collect()}
    assert got == {x: m for x, m in low.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_a_hub(spark):
    """A star whose hub is the largest vertex, and one whose hub is the smallest: no task reads much of it."""
    n = 100_000
    stars = spark.range(1, n).selectExpr("id as a", f"{n}L as b").unionByName(spark.range(1, n).selectExpr(f"{2 * n}L as a", f"id + {2 * n} as b"))
    got = components.components(stars).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(1, n), (2 * n, n)]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 24))
    x = np.concatenate([base, base[:80] + 0.3 * rng.standard_normal((80, 24)), base[:40], base[:60] * 3 + 0.9 * rng.standard_normal((60, 24))]).astype(np.float32)
    ids = list(range(5, 5 + len(x)))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(ids[i], ids[j]) for i in range(len(x)) for j in range(i) if u[i] @ u[j] >= 0.9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(links) and sum(r["n_links"] for r in got.values()) <= 2 * len(links)
    low = reach(ids, links)
    assert np.mean([got[i]["component_id"] == low[i] for i in ids]) >= 0.9


def test_recall_of_the_plan():
    rng = np.random.default_rng(6)
    for n in (2_000, 50_000, 10_000_000):
        bits, tables = embeddings.plan(n)
        a = rng.standard_normal((400, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((400, 64))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        met = (embeddings.keys_of(a, bits, tables) == embeddings.keys_of(0.9 * a + np.sqrt(0.19) * b, bits, tables)).any(axis=1)
        assert met.mean() >= 0.95


def test_decontamination(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 2, 1, 40])] + [(99, "unrelated text that never occurs anywhere in any of these documents at all")]
    docs = []
    for i in range(60):
        w = [r.choice(vocabulary) if r.random() < 0.5 else f"z{r.randrange(50)}" for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            t = items[r.randrange(8)][1].split()
            a = r.randrange(len(t))
            w[r.randint(0, len(w)) : 0] = t[a : a + r.randint(1, 30)]
        docs.append((i, ", ".join(w).title() if r.random() < 0.5 else "-".join(w)))
    expected = {}
    for i, text in docs:
        w, hit, names = alnum(text), set(), set()
        for name, item in items:
            t = alnum(item)
            k = min(10, len(t))
            for p in range(len(t) - k + 1):
                for q in range(len(w) - k + 1):
                    if w[q : q + k] == t[p : p + k]:
                        hit |= set(range(q, q + k))
                        names.add(str(name))
        expected[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 150):
        got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.digest(decontaminate.find(d, b, block_bytes=block)).collect()}
        assert got == expected
    assert sum(e[4] for e in expected.values()) > 10
    assert {x["doc_id"] for x in decontaminate.remove(d, b).collect()} == {i for i, e in expected.items() if not e[4]}


def test_mixing(spark):
    r = random.Random(9)
    docs = [(i, " ".join("x" * r.randint(1, 4) for _ in range(r.randint(0, 40))), r.choice(["b", "a", None, "c", "é", "b", "b", "b"])) for i in range(300)]
    rows = [x.asDict() for x in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()]
    sizes = defaultdict(int)
    for i, t, s in docs:
        sizes[s] += len(spaced(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    full, share = set(), 0.0
    while True:
        share = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * share >= 3 * sizes[s]}
        if not more:
            break
        full |= more
    for x in rows:
        s = x["source"]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(3 * sizes[s] if s in full else weight[s] * share)
        assert x["size"] == len(spaced(docs[x["doc_id"]][1])) and 0 <= x["taken"] <= 3 * x["size"]
    for s in order:
        mine = [x for x in rows if x["source"] == s]
        assert sum(x["taken"] for x in mine) == int(mine[0]["target"] + 0.5)
        epochs = int(mine[0]["target"] + 0.5) // sizes[s]
        part = [x for x in mine if x["size"] and epochs * x["size"] < x["taken"] < (epochs + 1) * x["size"]]
        assert len(part) <= 1 and all(x["taken"] >= epochs * x["size"] for x in mine)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, mixing.mix(df).collect()))
    copies = defaultdict(int)
    for x in mixing.repeated(df).collect():
        copies[x["doc_id"]] += 1
    for x in rows:
        if x["size"]:
            assert abs(copies[x["doc_id"]] - x["taken"] / x["size"]) <= 0.5


def test_sharding(spark):
    r = random.Random(10)
    docs = [(i, "é" * r.randint(0, 60)) for i in range(2000)]
    recs = sharding.records(spark.createDataFrame(docs, "doc_id long, text string"))
    stats = {x["virtual_slot"]: x["n_bytes"] for x in sharding.slot_stats(recs).collect()}
    first = sharding.fit_map(recs, 16)
    rows = sharding.numbered(sharding.assign(recs, first)).collect()
    text = dict(docs)
    for x in rows:
        assert x["size"] == len(text[x["doc_id"]].encode()) + 1 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode())
    loads = [sum(x["size"] for x in rows if x["shard"] == k) for k in range(16)]
    assert max(loads) <= 1.02 * min(loads)
    grown = sharding.rebalance(first, stats, 17)
    moved = [s for s in range(sharding.SLOTS) if first.shards[s] != grown.shards[s]]
    assert grown.version == 2 and sum(stats.get(s, 0) for s in moved) <= 1.2 * sum(stats.values()) / 17
    new = [sum(stats.get(s, 0) for s in range(sharding.SLOTS) if grown.shards[s] == k) for k in range(17)]
    assert max(new) <= 1.1 * min(new)
    assert sharding.rebalance(grown, stats).shards == grown.shards  # nothing to do, nothing moves
    shrunk = sharding.rebalance(first, stats, 15)
    assert max(shrunk.shards) == 14 and all(shrunk.shards[s] == k for s, k in enumerate(first.shards) if k < 15)


def test_stored_maps(spark, tmp_path):
    one = sharding.build_map({1: 5}, 3, slots=8)
    two = sharding.rebalance(one, {1: 5}, 4)
    for m in (one, two):
        m.save(spark, f"file://{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map") == two and sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 1) == one
    with pytest.raises(Exception, match="already exists"):
        one.save(spark, f"file://{tmp_path}/map")


def test_line_chunks(spark):
    r = random.Random(11)
    block = "\n".join(f"shared line number {i} of the passage" for i in range(30))
    own = lambda: "\n".join(f"own {r.random()} line" for _ in range(r.randint(1, 9)))
    docs = [(i, f"{own()}\n{block}\n{own()}" if i % 3 == 0 else own()) for i in range(30)] + [(100, None), (101, ""), (3, None)]
    rows = {(x["doc_id"], x["text"]): x for x in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        x = rows[i, t]
        if not t or i % 3 or i == 0:
            assert x["clean"] == t  # nothing repeats, or the first place
        else:
            assert 20 <= x["n_removed"] <= 30 and x["n_lines"] == len(t.split("\n"))
            left = [line for line in t.split("\n") if line in set(x["clean"].split("\n"))]
            assert left == x["clean"].split("\n")  # whole lines, in order
            assert all(line in x["clean"] for line in t.split("\n") if line.startswith("own"))


def test_passages_do_not_shift(spark):
    """Lines put in before a passage change nothing of what is taken out of it."""
    passage = [f"line {i} of the passage" for i in range(40)]
    docs = [(1, "\n".join(passage)), *((k, "\n".join([*(f"own {k} {j}" for j in range(k)), *passage, f"end {k}"])) for k in range(2, 12))]
    got = {x["doc_id"]: x["clean"] for x in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    assert all(got[k] == "\n".join([*(f"own {k} {j}" for j in range(k)), f"end {k}"]) for k in range(2, 12))


def test_differing_bytes_are_kept(spark, monkeypatch):
    """Windows of one rolling hash whose bytes differ are no repeats: with every hash the same, only equal bytes go."""
    windows = line_chunks.windows
    monkeypatch.setattr(line_chunks, "windows", lambda rows: windows(rows).withColumns({"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long")}))
    text = "a b\nc d\ne f\ng h\ni j\nk l\nm n\no p"
    docs = spark.createDataFrame([(1, text), (2, text + "\nend of it"), (3, "q r\ns t\nu v"), (4, "x y\na b\nc d")], "doc_id long, text string")
    found = {x["doc_id"]: (x["n_removed"], x["clean"]) for x in line_chunks.dedup_lines(docs).collect()}
    assert found == {1: (0, text), 2: (8, "end of it"), 3: (0, "q r\ns t\nu v"), 4: (2, "x y")}


def test_patience_alignment():
    def lis(pairs):
        best = [1] * len(pairs)
        for i in range(len(pairs)):
            best[i] = 1 + max([best[j] for j in range(i) if pairs[j][1] < pairs[i][1]], default=0)
        return max(best, default=0)

    r = random.Random(13)
    for _ in range(200):
        a = [r.randrange(40) for _ in range(r.randint(0, 25))]
        b = [r.randrange(40) for _ in range(r.randint(0, 25))]
        found = licenses.anchors(a, b)
        pairs = sorted((a.index(w), b.index(w)) for w in set(a) & set(b) if a.count(w) == 1 == b.count(w))
        assert len(found) == lis(pairs) and all(x < y and p < q for (x, p), (y, q) in zip(found, found[1:], strict=False))
        aligned = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in aligned) and all(x < y and p < q for (x, p), (y, q) in zip(aligned, aligned[1:], strict=False)) and len(aligned) >= len(found)
    assert licenses.align(list("abcXYdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (5, 3), (6, 4), (7, 5)]


def test_license_scan(spark):
    t = licenses.TEMPLATES
    noise = "lorem ipsum dolor sit amet the of and to in a "
    changed = t["MIT"].replace("free of charge", "free of any charge").replace("without limitation ", "")
    docs = [(1, noise * 50 + t["MIT-line"] + noise * 9 + t["CC-BY-NC-4.0-line"]), (2, changed), (3, noise * 200), (4, t["GPL-3.0"].upper().replace(" ", "\n  ")), (5, (t["all-rights-reserved"] + " ") * 3)]
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [m["name"] for m in got[1]] == ["MIT-line", "CC-BY-NC-4.0-line"] and got[3] == []
    assert [m["name"] for m in got[2]] == ["MIT"] and 0.9 < got[2][0]["coverage"] < 1
    assert [m["name"] for m in got[4]] == ["GPL-3.0"] and len(got[5]) == 3


def test_toxicity_folding():
    assert toxicity.fold("You 1D1OT, Ｍｏｒｏｎ and ѕсum—l0$er x86 2024") == " you idiot moron and scum loser xb6 2024 ".replace("xb6", toxicity.fold("x86").strip())
    model = toxicity.Model({" trash ": 2.0, " mor": 1.0})
    assert [h[2] for h in model.hits(toxicity.fold("Trash in the trash can"))] == [2.0]
    assert [h[2] for h in model.hits(toxicity.fold("mor moron"))] == [1.0]
    assert toxicity.fold("b" * 300_000) and toxicity.fold("1" * 300_000)


def test_toxicity_held_out(spark):
    r = random.Random(14)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(500)]
    docs, labels = [], []
    for i in range(1500):
        w = [r.choice(words) for _ in range(r.randint(5, 300))]
        bad = i % 8 == 0
        if bad:
            for _ in range(r.randint(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(["zorkest", "Z0rkling", "vexxu", "zork" + r.choice(words)]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    y = dict(labels)
    assert np.mean([(scores[i] >= 0.7) == y[i] for i in held]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    assert toxicity.fit(d, flipped) == toxicity.fit(d, lab)  # held-out labels are never read


def test_html_on_other_layouts():
    model = html_text.train()
    pages = html_text.training_pages(150, seed=77)
    parsed = [dom.parse(p, gold=True) for p in pages]
    right = 0
    for html, page, got in zip(pages, parsed, model.texts(pages), strict=True):
        right += got == dom.text_of(page, [(g or ("K" if 'data-root="K"' in html else "M")) == "K" for g in page.gold])
    assert right >= 0.85 * len(pages)


def test_html_decoding_is_hierarchical():
    rng = np.random.default_rng(15)
    parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, 9)])
    depth = np.zeros(9, int)
    for i in range(1, 9):
        depth[i] = depth[parent[i]] + 1
    allowed = {(0, 0), (0, 1), (1, 1), (2, 0), (2, 1), (2, 2)}
    for _ in range(20):
        log_p = np.log(rng.dirichlet([1, 1, 1], 9))
        best = max((sum(log_p[i, s // 3**i % 3] for i in range(9)), s) for s in range(3**9) if s % 3 != 1 and all((s // 3 ** int(parent[i]) % 3, s // 3**i % 3) in allowed for i in range(1, 9)))[1]
        assert html_text.decode(log_p, parent, depth).tolist() == [best // 3**i % 3 for i in range(9)]


def test_html_text():
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three <b>four</b></p><script>x</script><p>Five &copy six</article><footer>&copy; me</footer>"
    assert html_text.train().texts([page]) == ["A & B\nOne two three four\nFive © six"]


def test_pipeline(spark, tmp_path):
    r = random.Random(16)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(i, text(20)) for i in range(3)]
    docs, labels, toxic, leaks = [], [], set(), set()
    for i in range(600):
        t = text(r.randint(10, 60))
        if i % 9 == 0:
            t, _ = t + " zorkest vexxu zorkling vexxu", toxic.add(i)
        elif i % 20 == 1:
            t, _ = t + " " + bench[i % 3][1], leaks.add(i)
        docs.append((i, t, "en", f"src{i % 4}", len(t), "extra"))
        labels.append((i, 1, int(i in toxic)))
    copies = {1000 + i: docs[i][1].upper() for i in range(2, 60, 7)}
    docs += [(k, t, "en", "src0", len(t), "extra") for k, t in copies.items()] + [(5, docs[5][1], "en", "src1", 9, "extra"), (2000, None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(x["doc_id"] for x in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, d, str(tmp_path))
    assert one.columns == d.columns and set(ids(one)) == {i for i, *_ in docs} - toxic - {k for k in copies if k - 1000 in toxic}
    two = stages["minhash_near_dedup"](spark, one, str(tmp_path))
    assert set(two.columns) == set(d.columns) and ids(two) == sorted({i for i in range(600) if i not in toxic} | {2000})
    three = stages["benchmark_decontamination"](spark, two, str(tmp_path))
    assert set(ids(three)) == set(ids(two)) - leaks
    four = stages["mixing"](spark, three, str(tmp_path))
    assert set(four.columns) == set(d.columns) and set(ids(four)) <= set(ids(three))
    five = stages["sharding"](spark, four, str(tmp_path))
    assert ids(five) == ids(four) and {x["shard"] for x in five.collect()} <= set(range(16))
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(five)
