"""Each operator against a direct implementation on small tables with awkward rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motiontables.llm import (chat_tree, decontamination, licenses, lm_scores, near_duplicates, neighbours, packing, quality,
                              suffix_dedup, toxicity)
from motiontables.llm.shared import components

BASE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def table(spark, name):
    return spark.read.parquet(f"{BASE}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    """The small table, and nulls, empty and long texts, copies, repeated ids, and columns with clashing names."""
    base = table(spark, "documents").withColumn("node", F.lit(1).cast("long")).withColumn("key", F.lit("k"))
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \n\t ", None, "s", 4), (-4, "word", "en", None, 4),
           (-5, "é" * 70 + " the and of", "fr", "s", 81), (-6, "the and of it " * 3000, "en", "s", 42000),
           (-7, "same words again and again in a row of words that is long enough", "en", "s", 60),
           (-8, "same words again and again in a row of words that is long enough", "en", "s", 60),
           (-9, "ab" * 90, "en", "s", 180), (-10, "ab" * 60 + "c", "en", "s", 121)]
    return base.unionByName(spark.createDataFrame([(*r, 5, None) for r in odd], DOCS)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, none, k):
    got = {r.doc_id: tuple(r) for r in near_duplicates.near_duplicates(docs, k, 80).collect()}
    sets = {}
    for i, t in texts(docs):
        w = t.lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = root(a), root(b)
            first[max(a, b)] = min(a, b)
    assert got == {i: (i, len(sets[i]), root(i), root(i) == i) for i in sets}
    assert near_duplicates.near_duplicates(none, k, 80).count() == 0


def test_first_of_near_duplicates_keeps_columns_and_null_ids(spark, docs):
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = near_duplicates.first_of_near_duplicates(more)
    kept = {r.doc_id for r in near_duplicates.near_duplicates(docs).where("kept").collect()}
    assert out.columns == more.columns and {r.doc_id for r in out.collect()} == kept | {None}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def without_windows(rows, width=50):
    low = {}
    for i, t in rows:
        for s in range(len(t) - width + 1):
            low[t[s:s + width]] = min(i, low.get(t[s:s + width], i))
    for i, t in rows:
        hit = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - width + 1):
            if low[t[s:s + width]] < i:
                hit[s:s + width] = True
        yield i, t, hit[:-1]


def test_suffix_dedup(docs, none):
    got = {r.doc_id: tuple(r)[:5] for r in suffix_dedup.repeats(docs).collect()}
    for i, t, hit in without_windows(texts(docs)):
        kept = bytes(b for b, h in zip(t, hit) if not h)
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        assert got[i] == (i, len(t), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.repeats(none).count() == 0


def test_deduplicated_keeps_the_rest(docs, none):
    out = suffix_dedup.deduplicated(docs)
    kept = {}
    for i, t, hit in without_windows(texts(docs)):
        left = bytes(b for b, h in zip(t, hit) if not h).decode("utf-8", "ignore")
        if left or not hit.any():
            kept[i] = left
    assert out.columns == docs.columns and {r.doc_id: r.text or "" for r in out.collect()} == kept
    assert suffix_dedup.deduplicated(none).count() == 0


def test_transform_merge_against_sorted_suffixes():
    rng = np.random.default_rng(3)
    part = [rng.integers(97, 99, size=n).astype(np.uint8) for n in (60, 75, 80, 52, 66, 70)]
    part[3] = part[1][:52]
    found = suffix_dedup.interval_documents(part, np.array([5, 4, 9, 1, 3, 2]))
    low = {}
    for d, t in zip([5, 4, 9, 1, 3, 2], part):
        for s in range(len(t) - 49):
            w = t[s:s + 50].tobytes()
            low[w] = min(d, low.get(w, d))
    assert all(found[i][s] == low[t[s:s + 50].tobytes()] for i, t in enumerate(part) for s in range(len(t) - 49))


@pytest.mark.parametrize("window", [10, 3])
def test_decontamination(spark, docs, none, window):
    items = table(spark, "benchmark").unionByName(spark.createDataFrame(
        [(1000, "The And"), (1001, "word"), (1002, None), (1003, "same words again and again in a row"), (None, "row of words")],
        "item_id long, text string"))
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in items.where("item_id is not null").collect():
        w = word.findall((r.text or "").encode().lower())
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(r.item_id)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.matched(docs, items, window).collect()}
    for i, t in texts(docs):
        w, found = word.findall(t.lower()), set()
        hit = np.zeros(len(w), bool)
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j:j + n]))) is not None:
                    found |= own
                    hit[j:j + n] = True
        assert got[i] == (len(w), int(hit.sum()), sorted(found)), i
    cut = decontamination.decontaminated(docs, table(spark, "benchmark"))
    assert cut.columns == docs.columns and decontamination.matched(cut, table(spark, "benchmark")).where("n_hit > 0").count() == 0
    assert decontamination.matched(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.matched(none, items).count() == 0


def test_shards_find_what_one_automaton_finds(docs, spark, monkeypatch):
    items = table(spark, "benchmark")
    whole = sorted(decontamination.matched(docs, items).collect())
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 150)
    monkeypatch.setattr(decontamination, "SHARDS_A_PASS", 2)
    parts = sorted(decontamination.matched(docs, items).collect())
    assert [r[:3] + r[4:] for r in map(tuple, whole)] == [r[:3] + r[4:] for r in map(tuple, parts)]


def test_packing(docs, none):
    rows = packing.best_fit_packed(docs).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts(docs):
        ids = np.array([*own.encode(t.decode(), add_special_tokens=False).ids, 1], "<u4")
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.start) == [4096 * k for k in range(len(mine))]
        assert all(zlib.crc32(ids[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = (rows.offset + rows.length).groupby(rows.sequence_id).shift(fill_value=0)
    assert (ends == rows.offset).all() and (rows.offset + rows.length).max() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1
    assert packing.best_fit_packed(none).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(7)
    histogram = [0, *rng.integers(0, 4, size=64).tolist()]
    plan = packing.packed(histogram, 64)
    used = collections.Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert [used[x] for x in range(65)] == histogram


def test_word_ids_of_odd_texts():
    own, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("a<|endoftext|>b \x1c\x85x I'M  don't\t q", "é e\u0301 a\u0301b", "ΑΣ ΣΑΣ İx ŉ ſ", "x...y, z.,", "日本 語\u00a0of", ""):
        assert mine.ids(t) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_neighbours(spark):
    rows = table(spark, "embeddings").select("vec_id", "embedding").collect()
    size = len(rows[0].embedding)
    odd = [(-1, None), (-2, [0.0] * size), (-3, [None] * size), (-4, [float("nan")] * size), (-5, []), (None, [1.0] * size),
           (5000, list(rows[1].embedding)), (5050, list(rows[1].embedding)), (-50, [1.0, 2.0])]
    df = spark.createDataFrame([*map(tuple, rows), *odd], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, 50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    own = {i: np.array(v, float) for i, v in [*map(tuple, rows), (5000, rows[1].embedding), (5050, rows[1].embedding)]}
    found = wanted = 0
    for q in [i for i in own if i % 50 == 0]:
        cos = {i: float(v @ own[q] / np.sqrt((v @ v) * (own[q] @ own[q]))) for i, v in own.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        found += len({i for i, _ in got[q]} & set(best))
        wanted += len(best)
        assert all(abs(s - cos[i]) < 1e-12 for i, s in got[q]) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert found >= 0.9 * wanted and -50 not in got
    assert neighbours.nearest(df.where("false"), 50).count() == 0


def test_chat_tree(spark):
    said = "</s>[INST] ok [/INST]"
    odd = [(-7, 0, "user", said), (-7, 1, "assistant", said), (-8, 0, "to\nol", r"\\l<<<SYS>>\b<role:"), (-8, 1, None, None),
           (None, 0, "assistant", "x"), (-9, 0, "user", "a"), (-9, 0, "user", "a"), (-10, 0, "user", "a"), (-10, 1, "assistant", "")]
    df = table(spark, "conversations").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    nodes, turns = chat_tree.prefix_tree(df)
    got = {r.conv_id: tuple(r)[:5] for r in chat_tree.read_back(nodes, turns).collect()}
    want = collections.defaultdict(list)
    for r in df.collect():
        want[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    for c, rows in want.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in rows)
        assert got[c] == (c, len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    by_key = {bytes(r.node): r for r in nodes.collect()}
    place = {(bytes(r.tree), r.offset + i): t for r in by_key.values() for i, t in enumerate(r.token_ids)}
    assert len(place) == sum(len(r.token_ids) for r in by_key.values())
    for r in by_key.values():
        above, at = [], r.parent
        while at is not None:
            above.insert(0, by_key[bytes(at)])
            at = above[0].parent
        seen = [place[bytes(r.tree), i] for s in r.ancestors for i in range(s.start, s.end)]
        assert seen == [t for a in above for t in a.token_ids] and r.position == len(seen)
    assert chat_tree.read_back(*chat_tree.prefix_tree(df.where("false"))).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    size = toxicity.KINDS << toxicity.TABLE_BITS
    field = toxicity.Field(rng.normal(size=size), rng.normal(size=(2, 2)), 0.3)
    places, first = rng.integers(0, size, size=(toxicity.KINDS, 45)), np.array([0, 5, 13, 14, 22, 33])
    p, pairs = field.marginals(places, first, pairs=True)
    lift = field.weights[places].sum(0)
    for a, b in zip(first, [*first[1:], 45]):
        total, one = 0.0, np.zeros(b - a)
        for s in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(s[0] * field.begin + sum(x * lift[a + k] for k, x in enumerate(s)) + sum(field.moves[x, y] for x, y in zip(s, s[1:])))
            total += w
            one += np.array(s) * w
        assert np.allclose(one / total, p[a:b])
    assert np.allclose(pairs.sum((0, 1)), 1)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
    out = toxicity.toxic_documents(docs, labels, f"NOT ({held})").join(labels, "doc_id").where(held).toPandas()
    assert (out.predicted == out.toxic).mean() >= 0.9 and out.score.between(0, 1).all()


def test_toxicity_awkward(spark, docs, none):
    labels = table(spark, "labels")
    assert toxicity.toxic_documents(docs, labels).count() == docs.count()
    assert toxicity.toxic_documents(none, labels).count() == 0
    assert {r.score for r in toxicity.toxic_documents(docs, labels.where("false")).collect()} == {0.0}


def test_quality(spark, docs, none):
    base, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(base, labels).join(labels, "doc_id").toPandas()
    assert (out.good == (out.quality == 1)).mean() >= 0.95
    kept = quality.good_documents(docs, table(spark, "labels"))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.good_documents(docs, labels.where("false")).count() == docs.count()
    assert quality.quality_scores(none, labels).count() == 0


def test_lm_scores(spark, docs, none):
    target = table(spark, "labels").where("quality = 1").select("doc_id")
    got = {r.doc_id: r for r in lm_scores.cross_entropy_difference(docs, target).collect()}
    rows = texts(docs)
    from motiontables.llm.words import hash_words
    words = {i: hash_words(t) for i, t in rows}
    counts = collections.Counter(int(h) for w in words.values() for h in w)
    known = np.sort(np.array(sorted(counts, key=lambda h: (-counts[h], np.uint64(h).astype(np.int64)))[:lm_scores.KNOWN], np.uint64))
    chosen, n, b = {r.doc_id for r in target.collect()}, len(counts), lm_scores.BEGIN
    pairs = {}
    for i, w in words.items():
        v = lm_scores.numbered(w, known).tolist()
        pairs[i] = list(zip([b, *v], v))
    import pyarrow as pa
    fold = {i: int(lm_scores.fold_of(pa.array([i]))[0]) for i in words}
    for i in list(words)[::17]:
        losses = []
        for mine in (chosen, set(words)):
            own = [p for j in words if j in mine and fold[j] != fold[i] for p in pairs[j]]
            pair, before, one = collections.Counter(own), collections.Counter(u for u, _ in own), collections.Counter(w for _, w in own)
            losses.append(np.mean([-np.log((pair[u, w] + lm_scores.SMOOTHING * (one[w] + 1) / (len(own) + n)) / (before[u] + lm_scores.SMOOTHING))
                                   for u, w in pairs[i]]) if pairs[i] else None)
        if losses[0] is None:
            assert got[i].score is None
        else:
            assert np.allclose((got[i].target_loss, got[i].background_loss), losses, atol=1e-4)
    assert lm_scores.cross_entropy_difference(none, target).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"FREQUENT": 40, "HOT": 8, "PART_TOKENS": 500, "MOST_TOKENS": 700}])
def test_lm_scores_count_every_word(spark, monkeypatch, sizes):
    """3 000 words, every one counted by itself, wherever its count is taken."""
    import pyarrow as pa
    for name, size in sizes.items():
        monkeypatch.setattr(lm_scores, name, size)
    deal = np.random.default_rng(5)
    words = {i: [f"w{int(x)}" for x in 3000 * deal.random(40) ** 3] for i in range(400)}
    rows = [(i, " ".join(w)) for i, w in words.items()]
    chosen = set(range(0, 400, 3))
    got = {r.doc_id: r for r in lm_scores.cross_entropy_difference(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()}
    n = len({x for w in words.values() for x in w})
    assert len(got) == 400 and n > 2000
    fold = {i: int(lm_scores.fold_of(pa.array([i]))[0]) for i in words}
    for mine, loss in ((chosen, "target_loss"), (set(words), "background_loss")):
        for f in (0, 1):
            own = [p for i, w in words.items() if i in mine and fold[i] != f for p in zip(["", *w], w)]
            pair, before, one = collections.Counter(own), collections.Counter(u for u, _ in own), collections.Counter(w for _, w in own)
            for i, w in words.items():
                if fold[i] == f:
                    p = [(pair[u, v] + lm_scores.SMOOTHING * (one[v] + 1) / (len(own) + n)) / (before[u] + lm_scores.SMOOTHING)
                         for u, v in zip(["", *w], w)]
                    assert got[i].n_tokens == 40 and abs(got[i][loss] + np.log(p).mean()) < 1e-5


def test_licenses(spark, none):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under the Apache Licence, Version 2.0."), (3, "no such thing"),
            (4, None), (5, "All rights reserved by us and nobody else"), (6, "This work is licensed under the GNU General Public License, version 2."),
            (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = licenses.license_blocks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "license").collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT"), (2, "Apache-2.0"), (5, None), (6, "GPL-2.0"), (6, "GPL-3.0")]
    assert (got[0].start, got[0].end, got[0].differences) == (2, 33, []) and got[1].differences == ["replace: license -> licence"]
    assert licenses.license_blocks(none).count() == 0


def test_windows_of_one_word(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma beta"), (2, "delta"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "beta"), (8, "Gamma beta"), (9, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.item_ids)) for r in decontamination.matched(docs, items, window=1).collect()}
    assert got == {1: (3, [7, 8]), 2: (0, []), 3: (0, [])}


def test_near_duplicates_refuse_what_the_index_cannot_find(docs):
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(docs, 2, 79)


def test_one_leader_for_the_buckets_of_a_group(spark):
    """300 near copies: about one pair a document, not one for each of its keys."""
    keyed = spark.range(300).withColumnRenamed("id", "node").crossJoin(spark.range(50).withColumnRenamed("id", "key")).withColumn("size", F.lit(40).cast("long"))
    assert near_duplicates.star_pairs(keyed, 80).count() == 299
