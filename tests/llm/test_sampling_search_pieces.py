"""Importance resampling, piece encoding and lexical search beside plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from keyloom.llm import importance, pieces, search

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def prose(seed, n, sizes=(0, 60)):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß漢7") for _ in range(r.randint(1, 6))) for _ in range(150)]
    often = [1 / (1 + k) for k in range(len(words))]
    return [r.choice([" ", ", ", "\n", "\0"]).join(r.choices(words, often, k=r.randint(*sizes))).replace("a", r.choice("aA")) for _ in range(n)]


def texts(seed, n):
    """With nulls, empty texts, repeats, repeated ids and ids that are null."""
    found = [*prose(seed, n), None, "", " .;\0 ", "one", "same same same", "same same same", "x" * 40_000, "b c " * 9_000]
    return [(None if k % 17 == 5 else k - (k % 19 == 3), t) for k, t in enumerate(found)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(1, 120), "doc_id long, text string").repartition(5)


# --- importance resampling


def plain_resample(rows, target, max_n=1, buckets=10_000, percent=10):
    def grams(t):
        w = alnum(t)
        return Counter(b" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))

    def at(g):
        return zlib.crc32(g) % buckets

    s, t = Counter(), Counter()
    for out, many in ((s, [x for _, x in rows]), (t, target)):
        for x in many:
            for g, n in grams(x).items():
                out[at(g)] += n
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for i, x in rows:
        found = grams(x)
        weight = sum(n * gain(at(g)) for g, n in found.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(alnum(x))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((str((*r[:4], ranks.get(id(r)))) for r in out))


@pytest.mark.parametrize("max_n", [1, 3])
@pytest.mark.parametrize("hot", [1 << 16, 50])
def test_resample_is_the_plain_one(spark, docs, monkeypatch, max_n, hot):
    monkeypatch.setattr(importance, "HOT", hot)  # 50: most strings are merged and not broadcast
    target = prose(2, 30)
    wanted = spark.createDataFrame([(t,) for t in [*target, None]], "text string")
    got = importance.resample(importance.weights(docs, wanted, max_n=max_n), percent=30).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_resample(texts(1, 120), target, max_n, percent=30)


def test_dictionary_counts_every_string_once(spark, docs):
    got = importance.dictionary(docs).collect()
    n, n_docs = Counter(), Counter()
    for _, t in texts(1, 120):
        n.update(alnum(t))
        n_docs.update(set(alnum(t)))
    assert {r["feature"].encode(): (r["n"], r["n_docs"]) for r in got} == {w: (n[w], n_docs[w]) for w in n}
    assert len(got) == len(n)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, weight string")
    some = spark.createDataFrame([(1, "a " * 30, "w")], "doc_id long, text string, feature string")
    assert importance.resample(importance.weights(none, some)).count() == 0
    (row,) = importance.resample(importance.weights(some, none), percent=100).collect()
    assert (row["n_features"], row["rank"]) == (30, 1)


# --- pieces


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(4)
    alphabet = "  ▁▁aeiouthnrsABC019.,;:-_(){}\n\t\0éßжщのは漢字😀𐍈ﬁ́​"
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(400)]
    return [*made, *(" " * n for n in range(40)), *(f"a{' ' * n}b" for n in range(40)), "", "<s></s><unk><0x0A>", "�", "a" * 5000, " " * 5000, "\n" * 5000, "ab" * 3000, "x\ny " * 3000, *prose(5, 50)]


def test_pieces_are_those_of_the_library(spark, model, library, odd):
    rows = spark.createDataFrame([(k, t, k) for k, t in enumerate([*odd, None])], "doc_id int, text string, ids int").repartition(3)  # ``ids`` is replaced
    data = pieces.read_model(model)
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(rows, data), data).collect()}
    assert len(got) == len(odd) + 1 and got[len(odd)]["ids"] == [] and got[len(odd)]["decoded"] == ""
    for k, t in enumerate(odd):
        ids = library.encode(t)
        assert got[k]["ids"] == ids, t
        assert got[k]["decoded"] == library.decode(ids), t
        assert got[k]["text"] == t


def test_any_ids_decode_as_the_library_does(spark, model, library):
    r = random.Random(6)
    lists = [[r.randrange(0, 32_000) if r.random() < 0.5 else r.randrange(0, 262) for _ in range(r.randint(0, 9))] for _ in range(1500)]
    rows = spark.createDataFrame([(k, ids) for k, ids in enumerate([*lists, None])], "k int, ids array<int>")
    got = {x["k"]: x["decoded"] for x in pieces.decode(rows, pieces.read_model(model)).collect()}
    assert [got[k] for k in range(len(lists))] == [library.decode(ids) for ids in lists] and got[len(lists)] == ""
    with pytest.raises(Exception, match="does not have"):
        pieces.decode(spark.createDataFrame([(1, [32_000])], "k int, ids array<int>"), pieces.read_model(model)).collect()


def test_the_table_of_prefixes_is_the_merges(model):
    with open(model, "rb") as f:
        made = pieces.Pieces(f.read())
    r = random.Random(7)
    for _ in range(600):
        s = pieces.MARK * r.randint(0, 3) + "".join(r.choice(made.text[259:3000] + ["\n", "🜚"]) for _ in range(r.randint(1, 5)))
        assert [made.text[i] for i in made.run_ids(s)] == [x for part in made.merged(s) for x in ([part] if part in made.scores else [f"<0x{b:02X}>" for b in part.encode()])]


def test_pairs_are_tested_without_merging(model, monkeypatch):
    """What is said of two tokens is what their merges say, also of one piece twice and of pieces cut in two elsewhere; nothing is merged for it."""
    with open(model, "rb") as f:
        made = pieces.Pieces(f.read())
    r = random.Random(8)
    own = [t for t in made.scores if made.automaton.get(t, None)]
    set_of_own = set(own)
    short, marks = [t for t in own if len(t) <= 3], [t for t in own if not t.strip(pieces.MARK)]
    pairs = [(r.choice(x), r.choice(x)) for x in (own, short) for _ in range(3000)] + [(t, t) for t in r.sample(own, 500)] + [(a, b) for a in marks for b in marks]
    pairs += [(t[:k], t[k:]) for t in r.sample(own, 1500) for k in range(1, len(t)) if {t[:k], t[k:]} <= set_of_own]
    due = [made.merged(a + b) == [a, b] for a, b in pairs]
    assert {True, False} == set(due) and [made.stay(a, b) for a, b in pairs] == due
    monkeypatch.setattr(made, "merged", None)
    plain = [(a, b) for a, b in pairs if pieces.MARK * 2 not in a + b]
    assert len(plain) > 5000
    for a, b in plain:
        made.stay(a, b)


def test_letters_are_cut_from_what_stands_beside_them(model, library):
    with open(model, "rb") as f:
        made = pieces.Pieces(f.read())
    assert made.cut.findall("▁sur.***▁▁(a1)▁▁b🜚") == ["▁sur", ".***", "▁▁(", "a", "1)", "▁▁b", "🜚"]
    for text in ("sur.***  (a1)  b🜚", "l'été.Et...x", "a_b-c/d\\e]^f", "日本。語1"):
        assert made.ids(text) == library.encode(text)


def test_few_remembered_pairs(model, library, monkeypatch, odd):
    monkeypatch.setattr(pieces, "PAIRS", 5)
    with open(model, "rb") as f:
        made = pieces.Pieces(f.read())
    for text in odd[:150]:
        assert made.ids(text) == library.encode(text)
        assert sum(map(len, made._after.values())) <= 5


def test_a_model_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="no BPE"):
        pieces.Pieces(b"")


def test_no_documents_no_pieces(spark, model):
    data = pieces.read_model(model)
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id int, text string"), data), data).count() == 0


# --- search


def plain_search(rows, items, top):
    found = [(i, Counter(alnum(t))) for i, t in rows]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, every = len(found), sum(x for _, _, x in found)
    df = Counter(w for _, c, _ in found for w in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, t in items:
        scored = []
        for i, c, size in found:
            m = 75 + 25 * size * n // every
            scored.append((sum(w[x] * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m)) for x in alnum(t) if x in c), i))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("tiers", "block", "top"), [((4, 20), 1 << 20, 3), ((2,), 40, 5), ((1_000, 16_000), 1 << 20, 20), ((1, 2), 300, 1)])
def test_search_is_exact_in_every_tier(spark, docs, tiers, block, top):
    items = [(k, t) for k, t in enumerate([*prose(8, 12, (1, 6)), *prose(1, 6), None, "", "nothing of it", "same", "b b b c", "x" * 40_000])]
    wanted = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = search.search(docs, wanted, top=top, tiers=tiers, block=block).collect()
    assert sorted(str((r["item"], r["rank"], r["id"], r["score"])) for r in got) == plain_search(texts(1, 120), [*items, items[0]], top)
    if tiers == (4, 20):
        assert len({r["tier"] for r in got}) > 1  # some are proven early, others fall through


def test_search_keeps_equals_in_order_of_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 8)
    docs = spark.createDataFrame([(k * 7 % 60, "alpha beta") for k in range(60)] + [(100 + k, "gamma") for k in range(80)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([("i", "alpha")], "item_id string, text string")
    assert [r["id"] for r in search.search(docs, items, tiers=(5,)).orderBy("rank").collect()] == list(range(20))


def test_search_with_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert search.search(docs, none).count() == 0
    some = spark.createDataFrame([("i", "alpha")], "item_id string, text string")
    assert search.search(docs.limit(0), some).columns == search.search(docs, some).columns
    assert search.search(docs.limit(0), some).count() == 0
