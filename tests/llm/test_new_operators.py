"""Conversation trie, ranked search and toxicity against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablens.llm import lexical_search as ls
from tablens.llm import toxicity as tx
from tablens.llm.conversation_trie import conversation_trie
from tablens.llm.lexical_search import ranked_search
from tablens.llm.toxicity import toxicity

TURNS = "conv_id long, turn long, role string, text string, depth long, a long, n int"


def shared():
    return F.crc32(F.col("conv").cast("string").cast("binary")) % 6


def trie_by_hand(rows, taken):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    convs = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = taken(c)
        path = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": []})
            node["members"].append(c)
        nodes[path]["ends"].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, node in nodes.items():
        own = (len(node["members"]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    return {
        (
            min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), children[p], leaves[p],
            saved[p], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest(),
        )
        for p, n in nodes.items()
    }


def crc6(c):
    return zlib.crc32(str(c).encode()) % 6


def test_trie_of_odd_conversations(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", None]), r.choice(["a", "bb", "", None, "ç❤"]), 1, 2, 3) for c in range(-3, 30) for t in range(r.randint(1, 4))]
    rows += [(c, t, "user", f"same {t}", 1, 2, 3) for c in (100, 105, 117, 199, 200) for t in range(7)]
    rows += [(317, None, None, "no base", 1, 2, 3), (317, None, "x", "tie", 1, 2, 3), (317, 1, "x", "twice", 1, 2, 3), (317, 1, "x", "twice", 1, 2, 3)]
    rows += [(None, 1, "user", "nobody's", 1, 2, 3)]
    rows += [(c, t, "user", f"deep {t}" + "!" * (c == 455 and t > 37), 1, 2, 3) for c in (400, 455, 461) for t in range(300)]
    got = conversation_trie(spark.createDataFrame(rows, TURNS).repartition(3), shared()).collect()
    assert {tuple(x) for x in got} == trie_by_hand(rows, crc6)
    assert len(got) == len(trie_by_hand(rows, crc6))


def test_trie_without_sharing_and_of_nothing(spark):
    rows = [(1, 0, "u", "x", 1, 2, 3), (2, 0, "u", "x", 1, 2, 3), (2, 1, "u", "y", 1, 2, 3)]
    got = conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert {tuple(x) for x in got} == trie_by_hand(rows, lambda c: 0)
    assert conversation_trie(spark.createDataFrame([], TURNS), shared()).count() == 0


def test_trie_hashes_long_end_lists_in_chunks(spark):
    rows = [(c, 0, "u", "hello", 1, 2, 3) for c in range(7000)] + [(c, 0, "u", f"own {c}", 1, 2, 3) for c in range(7000, 7050)]
    got = conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert {tuple(x) for x in got} == trie_by_hand(rows, lambda c: 0)


DOCS = "doc_id long, text string, item_id long, score long, rank int, items int, h long"


def found_by_hand(docs, items):
    def terms(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    texts = [(i, Counter(terms(t))) for i, t, *_ in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms, df = len(texts), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    out = []
    for item, text in {(i, t) for i, t, *_ in items}:
        scored = []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            scored.append((sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]), i))
        best = sorted(((s, i) for s, i in scored if s), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:10]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_search_finds_what_scoring_all_documents_finds(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "ABC", "abc", "ñandú", "x1"]
    text = lambda n: r.choice([" ", "-", "\t"]).join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.choice([1, 5, 30, 200])), 1, 2, 3, 4, 5) for k in range(300)]
    copy = text(40)
    docs += [(k, copy, 1, 2, 3, 4, 5) for k in range(1000, 1060)]
    docs += [(7, None, 1, 2, 3, 4, 5), (8, "", 1, 2, 3, 4, 5), (8, "w1 w1 w2", 1, 2, 3, 4, 5), (None, copy, 1, 2, 3, 4, 5), (None, "w3 --", 1, 2, 3, 4, 5)]
    docs += [(2000, text(60000), 1, 2, 3, 4, 5)]
    items = [(k, text(12)) for k in range(12)] + [(20, copy), (20, copy), (20, "w1"), (21, None), (22, "!?"), (None, "w1 w1 nowhere"), (23, text(2000))]
    columns = "item_id long, text string, doc_id long, score int"
    monkeypatch.setattr(ls, "BLOCK_BYTES", 4000)  # several blocks of items
    got = ranked_search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(*x, 1, 2) for x in items], columns))
    assert sorted((tuple(x) for x in got.collect()), key=str) == found_by_hand(docs, [x for x in items if x[1]])
    monkeypatch.setattr(ls, "BROADCAST_ROWS", 0)
    got = ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, 1, 2) for x in items[:13]], columns))
    assert sorted((tuple(x) for x in got.collect()), key=str) == found_by_hand(docs, items[:13])


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, 2, 3, 4, 5)], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.where("false"), items).count() == 0
    assert ranked_search(docs, items.where("false")).count() == 0


def test_bounds_never_fall_short():
    r = random.Random(9)
    counts = [Counter(f"t{int(r.paretovariate(0.7))}".encode() for _ in range(r.randint(1, 400))) for _ in range(200)]
    total = sum(sum(c.values()) for c in counts)
    hashes = ls.Hashes()
    waiting = [
        (k, sum(c.values()), np.array([hashes[t] for t in c], np.uint64), np.array(list(c.values()), np.int64)) for k, c in enumerate(counts)
    ]
    item = dict(Counter(f"t{k % 30}".encode() for k in range(45)))
    weights = {t: 1000 + k for k, t in enumerate(item)}
    bounds, seen, near = ls.Bounds([item], weights, 200, total), 0, 0
    for ids, sizes, rows, slices in ls.signature_blocks(waiting):
        ((_, found),) = bounds.of_block(sizes, rows, slices)
        for k, bound in zip(ids, found[0]):
            extra = 8 * ls.length_factor(sum(counts[k].values()), 200, total)
            exact = sum(n * weights[t] * (10**9 * counts[k][t] // (1000 * counts[k][t] + extra)) for t, n in item.items() if counts[k][t])
            assert bound >= exact
            seen, near = seen + 1, near + (bound <= 1.1 * exact)
    assert seen == 200 and near > 150


LABELS = "doc_id long, toxic int, text string, score double, label int"


def toxic_corpus(r, n):
    plain, bad = [f"word{k}" for k in range(300)], ["vile", "gemein" + "heit", "gemeinling", "gemeiner"]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        words = [r.choice(plain) for _ in range(r.choice([20, 60, 300]))]
        if toxic:
            words = [r.choice(bad) if r.random() < 0.06 or j == 0 else w for j, w in enumerate(words)]
        rows.append((k, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus(random.Random(1), 600)
    docs = [(k, t, 1, 2, 3, 4, 5) for k, t, _ in rows] + [(None, None, 1, 2, 3, 4, 5), (700, "", 1, 2, 3, 4, 5), (701, "word1 " * 300_000, 1, 2, 3, 4, 5)]
    docs += [(702, "word1 vile " * 100_000, 1, 2, 3, 4, 5), docs[0]]
    labels = [(k, int(x), "t", 0.5, 1) for k, _, x in rows] + [(0, 0, "t", 0.5, 1), (1, None, "t", 0.5, 1), (None, 1, "t", 0.5, 1), (9999, 1, "t", 0.5, 1)]
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = toxicity(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS), ~fifth).collect()
    assert len(found) == len(docs)
    by_id = {row.doc_id: row for row in found}
    held = [(by_id[k].predicted, x) for k, _, x in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 90 and sum(p == x for p, x in held) / len(held) > 0.97
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in found)
    assert by_id[701].predicted == 0 == by_id[None].predicted and by_id[702].predicted == 1
    assert by_id[None].score == by_id[700].score
    assert by_id[702].evidence[0].toxic > 0 and by_id[702].nearest_cosine <= 1 + 1e-9


def test_toxicity_without_labels_or_with_one(spark):
    docs, labels = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 5), (2, "b", 1, 2, 3, 4, 5)], DOCS), spark.createDataFrame([(1, 1, "t", 0.5, 1)], LABELS)
    assert {(row.score, row.predicted) for row in toxicity(docs, labels.where("false"), F.lit(True)).collect()} == {(0.0, 0)}
    assert {row.predicted for row in toxicity(docs, labels, F.lit(True)).collect()} == {1}
    assert toxicity(docs.where("false"), labels, F.lit(True)).count() == 0


def test_nearest_examples_are_those_of_all_cosines():
    r = random.Random(2)
    vectors = sorted({tuple(sorted({r.randrange(40): r.randint(1, 900) for _ in range(r.choice([0, 1, 2, 3, 8]))}.items())) for _ in range(1500)})
    examples = [(v, r.random() < 0.3, k) for k, v in enumerate(r.choices(vectors, k=3000))]
    idf = np.linspace(1, 5, 40)
    index = tx.build_index(examples, idf)
    dense = np.zeros((len(index["keys"]), 41))
    for k, key in enumerate(index["keys"]):
        terms, weights = tx.vector(key, idf)
        dense[k, terms] = weights
    assert len(index["keys"]) > 3 * tx.BLOCK
    for query in [(), *r.sample(vectors, 60), ((3, 5), (39, 700))]:
        terms, weights = tx.vector(query, idf)
        cosines = dense[:, terms] @ weights
        found, near = tx.nearest(index, terms, weights)
        order = np.argsort(-cosines, kind="stable")[: len(found)]
        assert np.allclose(np.sort(cosines[order]), np.sort(near)) and index["members"][found].sum() > tx.NEIGHBOURS


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_lexical_search", "op13_toxicity"])
def test_registered(name):
    from tablens.llm.queries import QUERIES

    assert name in QUERIES


def test_held_out_toxicity_of_the_tables(spark):
    from tablens.llm.queries import op13_toxicity

    sf = "/root/testdata/sf0.01"
    found = op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = found.groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("rate")).collect()
    rate = {row.toxic: row.rate for row in rows}
    assert rate[0] < 0.05 and rate[1] > 0.5


def test_language_scores_do_not_fall_with_length_and_labels_may_be_many(spark):
    from tablens.llm.language import language_id

    r = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    text = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(k, text(lang, 40), lang) for k, lang in enumerate(list(letters) * 40)]
    long = [(1000, text("aa", 300_000), None), (1001, text("aa", 3600), None), (1002, "7" * 40_000 + text("bb", 100), None)]
    df = spark.createDataFrame(rows + long, "doc_id long, text string, lang string")
    found = {row.doc_id: row for row in language_id(df, F.lit(True)).collect()}
    assert [found[k].lang_pred for k in (1000, 1001, 1002)] == ["aa", "aa", "bb"]
    assert abs(found[1000].score - found[1001].score) < 0.05 and found[1000].score > 0.5
    many = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(300)], "doc_id long, text string, lang string")
    assert language_id(many, F.lit(True)).count() == 300
