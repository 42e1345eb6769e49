"""Source divergence, sharding and fill-in-middle against direct implementations, awkward rows included."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from motiontables.llm import divergence, middle_filling, sharding

BASE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, w0 long, row string"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table, and nulls, empty and long texts, copies, repeated rows, and columns with clashing names."""
    base = spark.read.parquet(f"{BASE}/documents.parquet").withColumn("w0", F.lit(1).cast("long")).withColumn("row", F.lit("k"))
    long_term, longer = "a" * 40, "Łódź" * 30
    odd = [(-1, None, None, None), (-2, "", "en", "s"), (-3, " \n\n\t ", None, "s"), (-4, "word", "en", None), (-5, "\n", "xx", "lone"),
           (-6, f"eightchr sixteencharacter {long_term} {longer} nine9nine ABCdefGHI " * 3, "en", "s"),
           (-7, f"Eightchr sixteencharacters {long_term}\n{longer} ABCdefGHI", "en", "t"),
           (-8, f"eightchr Sixteencharacter {long_term} {longer.upper()} {longer} abcdefghi", "en", "t"),
           (-9, "line <P> marked\nsecond\n", "en", "s"), (-10, "é\n" * 50_000 + "ü" * 70_001 + "\nend", "fr", "s"),
           (-11, "".join(f"{i} liné\n" for i in range(30_000)), "fr", "t"), (None, "no id\nbut lines\n", "en", "s"),
           (-12, "copy", "en", "s"), (-12, "copy", "en", "s"), (-13, "no end", "en", "s")]
    return base.unionByName(spark.createDataFrame([(*r, 5, 7, None) for r in odd], DOCS)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def expected_divergence(rows, least, top):
    terms = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    docs = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        terms[lang][source].update(found)
        docs[lang].update(set(found))
    for lang, groups in terms.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        whole = sum(groups.values(), collections.Counter())

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s in groups:
            pairs = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in groups if o != s]
            own = [((share[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and share[s][t] > q[t]]
            for part, values, limit in (("pair", pairs, None), ("term", own, top)):
                for i, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                    yield lang, s, part, item, v, i + 1


@pytest.mark.parametrize("tile, held, least, top", [(256, 400_000, 3, 200), (2, 50, 2, 5)])
def test_divergence(docs, monkeypatch, tile, held, least, top):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PART_ENTRIES", 2_000 if tile == 256 else 10**6)
    some = docs if tile == 256 else docs.where("doc_id < 0 OR doc_id IS NULL")
    got = sorted(tuple(r) for r in divergence.divergence_audit(some, least, top, held).collect())
    assert got == sorted(expected_divergence([tuple(r) for r in some.select("text", "lang", "source").collect()], least, top))


def test_divergence_of_nothing(none):
    assert divergence.divergence_audit(none).count() == 0


def test_exact_shares_of_large_counts(spark):
    n, whole = 3 * 10**12, 7 * 10**12
    right = 1 + 10**9 * (n + 1) // whole
    assert divergence.shares(np.array([n]), np.array([whole])).tolist() == [right]
    df = spark.createDataFrame([(n, whole)], "n long, whole long")
    assert df.select(divergence.share(F.col("n"), F.col("whole"))).first()[0] == right


def test_radix_order():
    rng = np.random.default_rng(5)
    low, high = rng.integers(0, 3, 5_000).astype(np.uint64), rng.integers(0, 1 << 63, 5_000).astype(np.uint64) >> np.uint64(20) << np.uint64(1)
    high[:4_000] = high[:40].repeat(100)
    assert divergence.radix_order(low, high).tolist() == np.lexsort((low, high)).tolist()


def check_shards(docs, shards, **options):
    got = sharding.sharded(docs, shards, **options).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    bytes_of, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, [bytes_of[i] for i in range(shards)]


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_shards(docs, shards):
    got, sizes = check_shards(docs, shards, columns=["doc_id", "text"])
    largest, mean = max(r.size for r in got), sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= largest + 0.02 * mean


def test_shards_of_copies(spark, monkeypatch):
    """A third of all rows is one text: its copies are parted evenly; small groups stay together; blocks change nothing."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    rows = [(i, "the same text in many copies") for i in range(600)] + [(1000 + i, f"text {i // 2} of two copies") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, sizes = check_shards(df, 16)
    assert max(sizes) - min(sizes) <= 0.04 * sum(sizes) / 16
    where = collections.defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert sum(len(s) > 1 for t, s in where.items() if "two" in t) <= 15


def test_shards_of_one_repeated_row(spark):
    df = spark.createDataFrame([(1, "again")] * 1600, "doc_id long, text string")
    assert check_shards(df, 16, tolerance=0)[1] == [600] * 16


def test_written_shards_and_nothing(spark, docs, none, tmp_path):
    assert sharding.sharded(none).count() == 0
    sharding.write_shards(docs.drop("n_chars"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.drop("n_chars").columns, "slot", "shard"] and back.count() == docs.count()


def test_sharding_is_native(docs):
    plan = sharding.sharded(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def expected_filled(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i: i + 8], 16) for i in range(0, 32, 8))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(lines), form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("frame", [7, 64 << 10])
def test_fill_in_middle(docs, none, frame):
    some = docs if frame > 7 else docs.where("doc_id NOT IN (-10, -11) OR doc_id IS NULL").limit(60)
    got = sorted((tuple(r) for r in middle_filling.digests(middle_filling.fill_in_middle(some, frame_bytes=frame)).collect()), key=str)
    assert got == sorted((expected_filled(r.doc_id, r.text) for r in some.collect()), key=str)
    assert middle_filling.digests(middle_filling.fill_in_middle(none)).count() == 0


def test_frames_across_marks_and_rates(spark):
    """A mark across two frames is seen; whole frames move as they are; a rate of 0 leaves all plain."""
    text = "x" * (middle_filling.FRAME_BYTES - 1) + "<M>" + "y\n" * 9
    df = spark.createDataFrame([(1, text), (2, "a\nb\nc\n" * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in middle_filling.fill_in_middle(df).collect()}
    assert got[1].form == "plain"
    whole = middle_filling.stored(df.where("doc_id = 2").first().text.encode(), zstandard.ZstdCompressor(level=1))
    assert len({bytes(f) for f in got[2].frames} & set(whole.frames)) >= 1 and len(got[2].frames) <= len(whole.frames) + 5
    assert {r.form for r in middle_filling.fill_in_middle(df, rate=0).collect()} == {"plain"}
