"""Exact duplicates, the audit of filters and resampling against brute force, on small tables and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import audit, exact, queries, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}
#: Columns whose names clash with the operators' own.
DOCS = "doc_id long, text string, lang string, key int, digest string, row string, mask int, part string, weight long, rank int, owner map<string,int>"
LONG = " ".join(f"w{i}" for i in range(150_000))
AWKWARD = [
    (1, None, "de"),
    (2, "", None),
    (3, "word", "en"),
    (3, "word", "en"),
    (4, "Zwei Wörter", "de"),
    (5, "x " * 60000, "en"),
    (6, LONG, "en"),
    (7, LONG, ""),
    (None, "word", "en"),
    (None, "no id here at all", "fr"),
    (8, "\t\n \r", "fr"),
    (9, "NOISE & Co", "fr"),
    (9, "other text, same id", "en"),
    (10, " ".join(f"w{i}" for i in range(120)), "en"),
    (11, "the same words " * 50, "en"),
]


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "d", "r", 3, "p", 7, 2, {"a": 1}) for i, t, lang in rows], DOCS)


def documents(spark, source):
    return spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else made(spark, AWKWARD if source == "awkward" else [])


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def order(row):
    return tuple((x is None, str(type(x)), x) for x in row)


def few_keys(text):
    return F.pmod(F.xxhash64(text), F.lit(3)) - 1


@pytest.mark.parametrize("source", ["table", "awkward", "empty"])
@pytest.mark.parametrize("key, capacity", [(F.xxhash64, exact.CAPACITY), (F.xxhash64, 2000), (few_keys, 100)])
def test_exact_duplicates(spark, source, key, capacity):
    docs = documents(spark, source)
    out = exact.duplicates(docs, key=key, capacity=capacity)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    held = defaultdict(list)
    for i, t in rows_of(docs, "doc_id", "text"):
        held[t or ""].append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in held.items()}
    want = sorted(((i, most[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in held.items() for i in ids), key=order)
    got = rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256", "kept")
    assert sorted((r[:4] for r in got), key=order) == want
    kept = Counter(r[3] for r in got if r[4])
    assert set(kept.values()) <= {1} and len(kept) == len(held)
    assert all(r[0] == r[1] for r in got if r[4])


def test_exact_duplicates_once_normalised(spark):
    out = exact.duplicates(made(spark, [(1, "A b", None), (2, "a B", None), (3, "c", None)]), normalised=F.lower)
    assert sorted(rows_of(out, "doc_id", "keep_id", "kept")) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_exact_duplicates_with_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("é", "x"), ("a", "y"), (None, "y")], "doc_id string, text string")
    out = exact.duplicates(docs)
    assert sorted(rows_of(out, "keep_id", "group_size", "kept")) == [("a", 2, False), ("a", 2, True), ("é", 2, False), ("é", 2, True)]


@pytest.mark.parametrize("key", [F.xxhash64, few_keys])
def test_documents_inserted_into_an_index(spark, key):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [docs.filter(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]
    index, sizes = None, []
    for part in parts:
        index = exact.inserted(index, part, exact.digests(part, exact._same, key), exact._same, key, 5000)
        sizes.append(len(index.directory.starts))
    marked = exact.digests(docs, exact._same, key)
    whole = exact.inserted(None, docs, marked, exact._same, key, 5000)
    columns = ("key", "digest", "keep_id", "group_size")
    assert sorted(rows_of(index.links, *columns)) == sorted(rows_of(whole.links, *columns))
    assert sizes[0] < sizes[2] or key is few_keys
    assert index.links.groupBy("key", "link").count().filter("count > 1").isEmpty()
    starts = {int(np.uint64(s).view(np.int64)) for s in index.directory.starts}
    assert {r.bucket for r in index.links.select("bucket").distinct().collect()} <= starts
    found = exact.looked_up(marked, index)
    assert sorted(rows_of(found, "row", "keep_id", "group_size")) == sorted(rows_of(exact.looked_up(marked, whole), "row", "keep_id", "group_size"))


def test_directory():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 2000, np.int64), rng.integers(0, 1000, 500)])  # a crowd in one range
    keys = np.unique(keys)
    now = exact.Directory.of_depth(0)
    for _ in range(64):
        cells = now.cells(keys)
        sizes = np.bincount(cells, np.full(len(keys), 10), len(now.starts) << exact.AHEAD).astype(int)
        then, held = now.split(sizes, np.bincount(cells, minlength=len(sizes)), 100)
        if len(then.starts) == len(now.starts):
            break
        now = then
    counted = np.bincount(now.bucket(keys), minlength=len(now.starts))
    assert counted.max() <= 10 and (counted * 10 == held).all()
    assert now.starts[0] == 0 and (np.diff(now.starts.astype(object)) == [1 << 64 - d for d in now.depths[:-1].tolist()]).all()


def test_a_hot_text(spark):
    docs = spark.range(6000, numPartitions=40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = Counter(rows_of(exact.duplicates(docs), "keep_id", "group_size", "kept"))
    assert found.pop((5999, 4000, False)) == 3999 and found.pop((5999, 4000, True)) == 1
    assert len(found) == 2000 and all(k[1:] == (1, True) and n == 1 for k, n in found.items())


def brute_mask(text, late):
    w = TOKEN.findall(text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * upper > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": late}


@pytest.mark.parametrize("source", ["table", "awkward", "empty"])
def test_audit(spark, source):
    docs = documents(spark, source)
    if source == "table":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
    else:
        labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 1), (9, None, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    good, toxic = ({r["doc_id"] for r in labels.collect() if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first, parts = {}, defaultdict(list)
    rows = [(i, t or "", lang or "") for i, t, lang in rows_of(docs, "doc_id", "text", "lang")]
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    for i, t, lang in rows:
        parts[lang].append((i, brute_mask(t, i is not None and i > first[t])))
    want, shapley = {}, Counter()
    for part, own in parts.items():
        for o in permutations("ABCDE"):
            left = own
            for s, f in enumerate(o, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[part, f] += len(gone)
                alone = sum(m[f] and sum(m.values()) == 1 for _, m in own)
                want[part, "".join(o), s] = [len(left), len(gone), sum(m[f] for _, m in own) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    got = {tuple(r[:3]): list(r[3:]) for r in audit.audited(docs, labels).collect()}
    assert got == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_first_failures_and_many_parts(spark, monkeypatch):
    table = audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for o, name in enumerate(audit.ORDERS):
            assert table[mask, o] == next((s for s, f in enumerate(name) if mask >> audit.FILTERS.index(f) & 1), 5)
    judged = spark.range(5000, numPartitions=2).selectExpr("cast(id % 2100 AS string) AS part", "cast(id % 32 AS int) AS mask", "id % 2 = 0 AS good", "true AS toxic")
    sums = audit.step_counts(judged).agg(F.sum("n"), F.sum("good"), F.sum("toxic"), F.count("*")).first()
    assert tuple(sums) == (600_000, 300_000, 600_000, 2100 * 720)


def test_crcs_of_runs():
    rng = random.Random(3)
    texts = [[bytes(rng.randrange(1, 256) for _ in range(rng.choice([1, 2, 5, 40, 3000]))) for _ in range(rng.randrange(0, 12))] for _ in range(30)]
    flat = [w for t in texts for w in t]
    crcs, lengths = np.array([zlib.crc32(w) for w in flat], np.uint32), np.array(list(map(len, flat)))
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for n, (found, of) in enumerate(resample.ngram_crcs(crcs, lengths, doc, 4), 1):
        want = [(zlib.crc32(b" ".join(t[i : i + n])), d) for d, t in enumerate(texts) for i in range(len(t) - n + 1)]
        assert list(zip(found.tolist(), of.tolist(), strict=True)) == want


@pytest.mark.parametrize("source", ["table", "awkward", "empty"])
@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, source, most, monkeypatch):
    monkeypatch.setattr(resample, "_AT_ONCE", 1000)
    docs = documents(spark, source)
    target = spark.read.parquet(f"{SF}/benchmark.parquet") if source != "empty" else spark.createDataFrame([], "item_id long, text string")
    buckets, share, least = 500, 30, 1

    def features(text):
        w = WORD.findall((text or "").translate(UP))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    rows = [(i, t, *features(t)) for i, t in rows_of(docs, "doc_id", "text")]
    s, t = Counter(b for r in rows for b in r[3]), Counter(b for (x,) in rows_of(target, "text") for b in features(x)[1])
    total = [sum(c.values()) for c in (s, t)]
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total[0] + buckets) / ((s[b] + 1) * (total[1] + buckets)))) for b in range(buckets)]
    want = []
    for i, _, w, f in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    may = sorted((x for x in want if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): n for n, x in enumerate(may[: len(may) * share // 100], 1)}
    want = sorted(((*x[:4], ranks.get(id(x))) for x in want), key=order)
    out = resample.resampled(docs, target, buckets, most, share, least)
    assert [t for _, t in out.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in out.collect()), key=order) == want


def test_registered(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op11_exact_dedup", "op13_resample"):
        assert queries.QUERIES[name](spark, SF).count() == n
