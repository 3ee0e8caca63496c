"""Operators beside plain versions of the whole job, on inputs where a part of it is easily left out."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import decontaminate, dom, html_text, licenses, line_chunks, minhash, mixing, preferences, sharding, toxicity


def plain_dedup(docs):
    """Every window of two lines but its first place (and what overlaps that) goes; texts in order of id."""
    first, clean = {}, {}
    for i, t in sorted(docs):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 1):
            at = first.setdefault((lines[k], lines[k + 1]), (i, k))
            if at not in ((i, k), (i, k - 1)):
                gone |= {k, k + 1}
        clean[i] = [x for k, x in enumerate(lines) if k not in gone]
    return clean


def test_line_passages_go_whole(spark):
    """Passages of 2 to 8 lines between other lines: all of their lines go, but at the first place."""
    r = random.Random(21)
    own = lambda: [f"own line {r.random()}" for _ in range(r.randint(1, 4))]
    passages = [[f"passage {p} line {k}" for k in range(n)] for p, n in enumerate([2, 3, 4, 5, 6, 7, 8] * 6)]
    docs, kept, first = [], {}, set()
    for i in range(150):
        lines, kept[i] = own(), []
        kept[i] += lines
        for p in r.sample(range(len(passages)), 2):
            more = own()
            lines, kept[i] = lines + passages[p] + more, kept[i] + (passages[p] if p not in first else []) + more
            first.add(p)
        docs.append((i, "\n".join(lines)))
    got = {x["doc_id"]: x for x in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i]["clean"].split("\n") == kept[i]
        assert got[i]["n_removed"] == t.count("\n") + 1 - len(kept[i])


@pytest.mark.parametrize("letters", [2, 6, 30])
def test_line_passages_beside_plain_version(spark, letters):
    """Lines of few kinds, where repeats overlap each other and themselves."""
    r = random.Random(letters)
    docs = [(i, "\n".join(f"line {r.randrange(letters)}" for _ in range(r.randint(1, 12)))) for i in range(60)]
    expected = plain_dedup(docs)
    for x in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect():
        assert [y for y in x["clean"].split("\n") if y] == expected[x["doc_id"]]


@pytest.mark.parametrize("equal", [False, True])
def test_mixing_without_ids(spark, equal):
    """Rows without an id are cut among themselves: each source gets its budget to half a row, whole epochs for all."""
    r = random.Random(23)
    docs = [(None if k % 3 else k, ("x " * 7 if equal else "x " * r.randint(1, 20) + str(k)).strip(), "abc"[k % 2 + (k % 5 == 0)]) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mixed = mixing.mix(df).collect()
    assert Counter((x["doc_id"], x["source"], x["size"]) for x in mixed) == Counter((i, s, len(t.split())) for i, t, s in docs)
    budget = {x["source"]: int(x["target"] + 0.5) for x in mixed}
    got = [tuple(x) for x in mixing.repeated(df).collect()]
    for s in "abc":
        assert sum(x["taken"] for x in mixed if x["source"] == s) == budget[s]
        assert abs(sum(len(t.split()) for _, t, q in got if q == s) - budget[s]) <= 10
        epochs = budget[s] // sum(len(t.split()) for _, t, q in docs if q == s)
        had, now = Counter(d for d in docs if d[2] == s), Counter(d for d in got if d[2] == s)
        assert all(epochs * n <= now[d] <= (epochs + 1) * n for d, n in had.items())
    assert sorted(map(str, got)) == sorted(map(str, map(tuple, mixing.repeated(df.repartition(7)).collect())))


def copies_of(r, n, vocabulary, kinds=1, length=60):
    """Near copies of ``kinds`` texts, each with two or three words changed, at most a quarter of the shingles apart from the text itself."""
    bases = [[r.choice(vocabulary) for _ in range(length)] for _ in range(kinds)]
    out = []
    for i in range(n):
        words = list(bases[i % kinds])
        at = r.randrange(length - 3)
        for k in range(at, at + r.randint(1, 3)):
            words[k] = r.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


def test_near_copies_are_not_replicated(spark, monkeypatch):
    """20,000 near copies of three texts: one component each, and no member stands in more than a few blocks of a bucket."""
    r = random.Random(31)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    docs = spark.createDataFrame(copies_of(r, 20_000, vocabulary, 3), "doc_id long, text string").repartition(8)
    seen = []
    reach = minhash._in_reach

    def counted(blocks, percent):
        per = blocks.groupBy("key", "rep").count()
        seen.append((blocks.count(), per.count(), blocks.groupBy("key", "part", "other").count().agg({"count": "max"}).first()[0]))
        return reach(blocks, percent)

    monkeypatch.setattr(minhash, "_in_reach", counted)
    got = minhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted((x["component_id"], x["count"]) for x in got) == [(0, 6667), (1, 6667), (2, 6666)]
    rows, members, largest = seen[0]
    assert rows <= 1.25 * members and largest <= 2 * minhash.SIDE


def test_one_of_each_keeps_every_text(spark):
    """Ids on several texts, rows without ids, rows alike in all, and extra columns."""
    r = random.Random(32)
    text = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(30))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (None, c, "x"), (None, c.upper(), "y"), (None, d, "x"), (7, d.upper(), "y"), (8, None, "x"), (8, None, "x"), (9, "", "y"), (5, b, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __r1 string").withColumnRenamed("__r1", "maybe")
    got = sorted((x["doc_id"] or 0, (x["text"] or "").lower()) for x in minhash.one_of_each(df).collect())
    assert got == sorted([(1, a), (1, b), (0, c), (7, d), (8, ""), (8, ""), (9, "")])
    assert minhash.one_of_each(df).columns == df.columns and minhash.one_of_each(df.limit(0)).count() == 0


def test_near_equal_bytes_with_one_id(spark):
    """Half of the rows share an id, a third of them their text too: shards are near equal in bytes, and reruns agree."""
    r = random.Random(33)
    rows = [(7 if k % 2 else k, "same text" if k % 3 == 0 else "x" * r.randint(0, 40)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shards(docs):
        recs = sharding.records(docs)
        return sharding.numbered(sharding.assign(recs, sharding.fit_map(recs, 16))).select("doc_id", "size", "text_crc32", "shard", "slot").collect()

    once = shards(df)
    assert Counter((x["doc_id"], x["size"]) for x in once) == Counter((i, len(t) + 1) for i, t in rows)
    loads = Counter()
    for x in once:
        loads[x["shard"]] += x["size"]
    assert max(loads.values()) <= 1.02 * min(loads.values())
    assert sorted(map(str, once)) == sorted(map(str, shards(df.repartition(11))))
    whole = sharding.sharded(df, 16).groupBy("shard").agg({"text": "count"}).collect()
    assert len(whole) == 16 and max(x[1] for x in whole) <= 1.5 * min(x[1] for x in whole)


def test_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    stats = {s: 100 + s % 7 for s in range(sharding.SLOTS)}
    one = sharding.current_map(spark, path, stats, 16)
    assert one.version == 1 and sharding.current_map(spark, path, stats, 16) == one  # still even: nothing is stored
    changed = stats | {s: 900 for s in range(200) if s % 2}
    two = sharding.current_map(spark, path, changed, 16)
    loads = [sum(changed[s] for s in range(sharding.SLOTS) if two.shards[s] == k) for k in range(16)]
    assert two.version == 2 and max(loads) <= 1.03 * min(loads)
    assert sum(a != b for a, b in zip(one.shards, two.shards, strict=True)) < 400  # the rest stays
    assert sharding.SlotMap.load(spark, path) == two and sharding.SlotMap.load(spark, path, 1) == one
    # a version that a lost driver left half written is passed over
    two.frame(spark).filter("virtual_slot % 2 = 0").drop("version").write.parquet(f"{path}/version=3")
    assert sharding.SlotMap.load(spark, path) == two
    assert sharding.current_map(spark, path, {s: 2000 if k == 3 else 100 for s, k in enumerate(two.shards)}, 16).version == 4


def test_matches_of_repeated_words(spark):
    """An item and texts of few words that repeat: hits beside a plain count, matches verbatim and as long as they can be."""
    r = random.Random(34)
    items = [(1, "a " * 300), (2, "a b " * 40), (3, " ".join(r.choice("ab") for _ in range(60))), (4, "a b c")]
    docs = [(1, "a " * 2000), (2, "b a " * 50 + "c"), (3, " ".join(r.choice("ab") for _ in range(400))), (4, "a b c a b"), (5, "b " * 30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = {i: t.split() for i, t in items}
    found = {x["doc_id"]: x["matches"] for x in decontaminate.find(d, b).collect()}
    for i, t in docs:
        w, hit = t.split(), set()
        for v in words.values():
            k = min(10, len(v))
            windows = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
            hit |= {p + j for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in windows for j in range(k)}
        assert hit == {m["start"] + j for m in found[i] for j in range(m["n_words"])}
        for m in found[i]:
            v = words[m["item"]]
            assert w[m["start"] : m["start"] + m["n_words"]] == v[m["item_start"] : m["item_start"] + m["n_words"]]
            assert m["start"] + m["n_words"] == len(w) or m["item_start"] + m["n_words"] == len(v) or w[m["start"] + m["n_words"]] != v[m["item_start"] + m["n_words"]]
    assert max(m["n_words"] for m in found[1]) == 300


def test_long_items_and_many_blocks(spark, monkeypatch):
    """Items cut into pieces and a benchmark of many blocks and passes give what one block gives."""
    r = random.Random(35)
    text = lambda n: " ".join(str(r.randrange(400)) for _ in range(n))
    items = [(k, text(r.choice([3, 9, 40, 400]))) for k in range(30)]
    docs = [(k, text(30) + " " + " ".join(items[k % 30][1].split()[k % 7 : k % 7 + 35]) + " " + text(5)) for k in range(120)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:5], "item_id long, text string")
    one = sorted(map(str, decontaminate.digest(decontaminate.find(d, b)).collect()))
    monkeypatch.setattr(decontaminate, "SHARD", 100)
    assert sorted(map(str, decontaminate.digest(decontaminate.find(d, b, block_bytes=2000, at_once=2)).collect())) == one
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    pieces = decontaminate._pieces(b.selectExpr("item_id as item", "text"), 10).collect()
    assert len(pieces) > 60 and max(len(x["text"].split()) for x in pieces) <= 59


def test_ten_megabytes_of_one_word():
    """Time and memory grow with the text, not with its square."""
    import pyarrow as pa

    s = decontaminate.Suffixes.of([1], [0], ["a " * 20_000])
    counts = np.zeros(1, np.int64)
    began = time.perf_counter()
    doc, item, place, start, depth = decontaminate._places(s, list(decontaminate._shards(pa.array(["a " * 5_000_000]), [s], 10, counts)))
    runs = decontaminate._runs(s, doc, item, place, start)
    assert counts[0] == 5_000_000 and len(place) == 5_000_000 - 9 and len(runs) == -(-len(place) // (20_000 - 9))
    assert time.perf_counter() - began < 60


def test_toxicity_beside_naive_matching():
    """The automaton and the sweep over exception phrases beside plain comparison at every place."""
    r = random.Random(36)
    weights = {f" {''.join(r.choice('ab') for _ in range(r.randint(1, 4)))}{' ' if r.random() < 0.5 else ''}": r.uniform(1, 5) for _ in range(25)}
    phrases = tuple({f" {a} {b} " for a in ("a", "ab", "b", "bb") for b in ("a", "ba", "b") if r.random() < 0.5})
    model = toxicity.Model(weights, phrases)
    for _ in range(300):
        folded = toxicity.fold(" ".join("".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 40))))
        held = [(i, i + len(p)) for p in phrases for i in range(len(folded)) if folded.startswith(p, i)]
        best = {}
        for term, w in weights.items():
            for i in range(len(folded)):
                whole = term.endswith(" ") or folded[i + len(term) : i + len(term) + 1] != " "
                if folded.startswith(term, i) and whole and not any(a <= i and i + len(term) <= b for a, b in held):
                    best[i] = max(best.get(i, (0, 0)), (w, len(term)))
        assert {h[0]: h[2] for h in model.hits(folded)} == {i: w for i, (w, _) in best.items()}


def test_learned_exceptions(spark):
    """A word of toxic texts that clean texts hold in one phrase: the phrase is learned, and the word still counts elsewhere."""
    r = random.Random(37)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    text = lambda: [r.choice(words) for _ in range(30)]
    docs, labels = [], []
    for i in range(900):
        w = text()
        if i % 5 == 0:
            w[10:10] = ["zorkest"]
        elif i % 90 == 1:
            w[10:10] = ["zorkest", "bin"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " zorkest bin " in model.exceptions and model.hits(" you zorkest bin ") == [] and model.hits(" you zorkest ")


def test_ten_megabytes_of_exceptions_and_tags():
    """Texts made to be slow are read in time that grows with their length."""
    model = toxicity.Model({" trash ": 2.0}, (" trash can ",))
    began = time.perf_counter()
    assert model.measure("trash can trash " * 625_000) == (2.0 * 625_000, 1_875_000)
    for page in ("<b>" * 700_000 + "</i>" * 700_000 + "x", "<p><select>" + "<b>" * 700_000 + "<hr>" * 400_000, "<ul>" + "<li>x" * 500_000, "<table>" + "<tr><td>x" * 300_000):
        assert dom.parse(page).tag[0] == "#page"
    assert time.perf_counter() - began < 60
    deep = ["<div>" * 100_000 + "deep", "<div><p>x" * 50_000]
    began = time.perf_counter()
    assert len(html_text.train().texts(deep)) == 2
    assert time.perf_counter() - began < 60


def test_html_open_elements_beside_walking():
    """What an end tag and an implied end close, beside walking through what is open."""
    r = random.Random(38)
    names = ["p", "div", "ul", "li", "table", "tr", "td", "b", "a", "select", "option", "dl", "dt", "dd", "hr"]

    def plain(tags):
        open_, out = ["#page"], []
        for end, name in tags:
            walk = range(len(open_) - 1, 0, -1)
            if end:
                at = next((k for k in walk if open_[k] == name), 0)
                if at:
                    del open_[at:]
            else:
                kinds = ("p",) if name in dom.ENDS_P else dom.NEXT.get(name, ())
                for k in walk:
                    if open_[k] in kinds:
                        del open_[k:]
                        if name != "tr":
                            break
                    elif open_[k] in dom.SCOPE:
                        break
                if name not in dom.VOID:
                    open_.append(name)
                    if name not in dom.INLINE:
                        out.append((name, sum(x not in dom.INLINE for x in open_) - 1))
        return out

    for _ in range(400):
        tags = [(r.random() < 0.3, r.choice(names)) for _ in range(r.randint(1, 40))]
        page = dom.parse("".join(f"<{'/' * end}{name}>" for end, name in tags))
        assert list(zip(page.tag[1:], page.depth[1:], strict=True)) == plain(tags)


def test_preferences_beside_plain_version(spark):
    """Pairs that part anywhere, or nowhere, with turns of many kinds."""
    r = random.Random(39)
    turn = lambda: (r.choice(["user", "assistant", "system", None]), r.choice(["a", "bb", "é" * 3, "", None]))
    pairs = []
    for k in range(200):
        head = [turn() for _ in range(r.randint(0, 6))]
        pairs.append((k, head + [turn() for _ in range(r.randint(0, 5))], head + [turn() for _ in range(r.choice([0, 1, 300]) if k % 20 == 0 else r.randint(0, 5))], "x"))
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(pairs, f"id long, chosen {kind}, rejected {kind}, prompt string")

    def rendered(turns):
        text, spans = "", []
        for role, said in turns:
            head = f"<|{'user' if role is None else role}|>\n"
            text += head + (said or "") + "<|end|>\n"
            if role == "assistant":
                spans.append(f"{len(text) - len(said or '') - 8}:{len(text)}")
        return text, ",".join(spans)

    got = {x["id"]: x for x in preferences.preference_pairs(df).collect()}
    for k, a, b, _ in pairs:
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        x = got[k]
        assert (x["n_common"], x["prompt"]) == (n, rendered(a[:n])[0])
        assert (x["chosen_completion"], x["chosen_spans"]) == rendered(a[n:]) and (x["rejected_completion"], x["rejected_spans"]) == rendered(b[n:])


def test_license_coverage_beside_dynamic_programming(spark):
    """Edited notices between other words: each is found at its place and by its name, and its coverage is near the best alignment's."""
    def best(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    r = random.Random(40)
    words_of = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    names = [n for n, t in licenses.TEMPLATES.items() if len(words_of(t)) > 20]
    docs, planted = [], {}
    for i in range(150):
        name = r.choice(names)
        words = words_of(licenses.TEMPLATES[name])
        for _ in range(r.randint(0, len(words) // 20)):
            k = r.randrange(1, len(words) - 1)
            words[k : k + r.randint(0, 1)] = [f"other{r.randrange(99)}"]
        before = [f"own{r.randrange(999)}" for _ in range(r.randint(0, 30))]
        docs.append((i, " ".join([*before, *words, *(f"end{k}" for k in range(5))])))
        planted[i] = (name, len(before), words)
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (name, first, words) in planted.items():
        template = words_of(licenses.TEMPLATES[name])
        top = best(words, template) / len(template)
        m = [x for x in got[i] if x["name"] == name]
        assert len(got[i]) == len(m) == 1 and m[0]["first_word"] == first and m[0]["end_word"] <= first + len(words)
        assert top - 0.03 <= m[0]["coverage"] <= top + 1e-9


def test_overlapping_notices_are_named_once():
    r = random.Random(41)
    for _ in range(300):
        found = [(str(k), r.random(), a := r.randrange(40), a + r.randint(1, 9), r.randint(1, 20)) for k in range(r.randint(0, 12))]
        kept, left = [], sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0]))
        while left:
            kept.append(left[0])
            left = [m for m in left[1:] if m[3] <= kept[-1][2] or m[2] >= kept[-1][3]]
        assert licenses.apart(found) == sorted((m[:4] for m in kept), key=lambda m: m[2])
