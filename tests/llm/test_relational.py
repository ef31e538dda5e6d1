"""Operators against brute force on the smallest tables and on rows made to be awkward."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenlake.llm import chat, decontaminate, license, queries, simhash, sketch, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, gram string, pos int, n int"


def words(text):
    return WORD.findall((text or "").translate(UP))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(spark, rows):
    """A documents table with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", 1, 2) for i, t in rows], DOCS)


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "word"),
    (3, "word"),
    (4, "Zwei Wörter"),
    (5, "x " * 60000),
    (None, "no id here at all"),
    (7, "\t\n \r"),
    (8, "Under the MIT License. under the mit license!"),
    (8, "other text, same id"),
    (9, "Apache License, Version 2.0 and CC-BY-NC"),
]


def brute_licenses(text):
    w = words(text)
    found = [(label, i) for label, p in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for _, i in found), default=None), max((i for _, i in found), default=None), ",".join(sorted({x for x, _ in found}))


@pytest.mark.parametrize("source", ["table", "awkward", "empty"])
def test_licenses(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else made(spark, AWKWARD if source == "awkward" else [])
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    out = license.licenses(docs).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=key)
    assert got == sorted(((i, *brute_licenses(t)) for i, t in rows), key=key)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_licenses_of_repeated_rows(spark):
    texts = ["cc by nc", "code under the mit license", "only under the mit", "apache license version 2 and cc by nc"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, t) for t in texts] * 3
    out = license.licenses(made(spark, rows)).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=key)
    assert got == sorted(((i, *brute_licenses(t)) for i, t in set(rows)), key=key)


def test_license_notice_with_edits(spark):
    notice = license.NOTICES["mit"][0].replace("hereby", "now hereby").replace("obtaining", "who obtains")
    split = license.NOTICES["mit"][0].split(" ")
    inside = lambda extra: " ".join([*split[:12], *extra.split(" "), *split[12:]])
    texts = [f"Intro words. {notice} end.", "permission to copy this software", inside("permission is hereby"), inside("one two three four five"), "permission is hereby granted " * 9]
    got = license.licenses(made(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "", "mit", "mit", ""]
    assert {r.base_labels for r in got} == {""}


def brute_notices(text):
    """Labels by diagonals, text by text."""
    w, found = words(text), set()
    for label, lines in license.NOTICES.items():
        for t in map(words, lines):
            by = defaultdict(set)
            for i in range(len(w) - 2):
                for j in range(len(t) - 2):
                    if w[i : i + 3] == t[j : j + 3]:
                        by[i - j].add(j)
            held, before = set(), None
            for d in sorted(by):
                held = (set() if before is None or d - before > len(t) / 2 else held) | {x for j in by[d] for x in (j, j + 1, j + 2)}
                before = d
                if len(held) >= 0.8 * len(t):
                    found.add(label)
    return found


def test_license_labels_by_brute_force(spark):
    rng = random.Random(8)
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents")}
    for lines in license.NOTICES.values():
        for line in lines:
            for _ in range(6):  # words lost, added and changed
                w = line.split()
                for _ in range(rng.randrange(4)):
                    at = rng.randrange(len(w))
                    w[at : at + rng.randrange(2)] = ["odd"] * rng.randrange(5)
                texts[len(texts) + 10**6] = " ".join(["before", *w, "after", *rng.choices(line.split(), k=30)])
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), set(filter(None, r.base_labels.split(",")))) for r in license.licenses(made(spark, list(texts.items()))).collect()}
    assert got and all(labels == brute_notices(texts[i]) | base for i, (labels, base) in got.items())
    assert sum(bool(labels - base) for labels, base in got.values()) > 30 and sum(i >= 10**6 and not labels for i, (labels, _) in got.items()) > 5


def brute_contamination(docs, items):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + n])].add(item)
    for i, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if got := wins.get(tuple(w[s : s + n])):
                    own |= got
                    hit |= set(range(s, s + n))
        yield i, len(w), len(hit), len(own), sha(",".join(sorted(map(str, own))))


def test_contamination_of_tables(spark):
    got = sorted(tuple(r)[:5] for r in queries.op8_decontaminate(spark, SF).collect())
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents")]
    assert got == sorted(brute_contamination(docs, [(r["item_id"], r["text"]) for r in table(spark, "benchmark")]))
    assert any(r[2] for r in got)


def test_contamination_of_awkward_rows(spark):
    rng = random.Random(1)
    items = [(1, " ".join(rng.choices("abc", k=30))), (2, "one"), (3, "Two words"), (4, None), (5, ""), (6, " ".join("abcdefghijklm")), (7, "one")]
    docs = [*AWKWARD, (20, " ".join(rng.choices("abc", k=3000))), (21, "one TWO words, one"), (22, " ".join("abcdefghijklm") * 3), (23, " ".join("xabcdefghijk"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(made(spark, docs), bench).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, sha(",".join(r["items"]))) for r in out), key=key)
    assert got == sorted(brute_contamination(dict.fromkeys(docs), items), key=key)
    out = decontaminate.contamination(made(spark, docs), bench, block=7).collect()  # many blocks
    assert got == sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, sha(",".join(r["items"]))) for r in out), key=key)
    left = {r.doc_id for r in decontaminate.decontaminated(made(spark, docs), bench).collect()}
    assert left == {r[0] for r in brute_contamination(docs, items) if not r[2]}


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(made(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(made(spark, AWKWARD), bench).collect()} == {0}
    assert decontaminate.decontaminated(made(spark, AWKWARD), bench).count() == len(AWKWARD)


def test_chat_of_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in table(spark, "conversations")]
    hostile = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    talks = defaultdict(list)
    for c, n, role, text in sorted(rows):
        talks[c].append((role, text))
    want = {}
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_format(spark, SF).collect()} == want


def test_chat_of_awkward_turns(spark):
    bits = ["<", "|", "\\", "<|end|>", "<\\|part|>", "[INST]", "[\\/INST]", "</s>", "<s>", "x", "\n", "é", "", "<|"]
    rng = random.Random(2)
    rows = [(c % 4 or None, rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "assistant", None, "a<|end|>b"]), "".join(rng.choices(bits, k=rng.randrange(6))) or None) for c in range(400)]
    for chunk in (1, 7, 256):
        out = chat.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("chunk", F.lit(1)), chunk)
        got = out.select("conv_id", "formatted", "mask", chat.turns_of(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("mask")).alias("l")).collect()
        for r in got:
            turns = sorted(((-1 if n is None else n, role or "", text or "") for c, n, role, text in rows if c == r.conv_id))
            assert [tuple(t) for t in r.t] == [t[1:] for t in turns]
            assert r.l == "".join(t for _, role, t in turns if role == "assistant")
            assert sum(m.skip + m.take for m in r.mask) == len(r.formatted)
            merged = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
            assert r.formatted.count("<|start|>") == merged
        assert len(got) == 4
    assert chat.formatted(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def brute_simhash(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)[0]:
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_of_table(spark):
    rows = {r["doc_id"]: brute_simhash(r["text"]) for r in table(spark, "documents")}
    got = {r.doc_id: r for r in queries.op5_simhash(spark, SF).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in rows.items()}
    ids, comp = sorted(rows), brute_components([rows[i] for i in sorted(rows)])
    low = {c: min(i for i, d in zip(ids, comp) if c == d) for c in comp}
    assert {i: r.component_id for i, r in got.items()} == {i: low[c] for i, c in zip(ids, comp)}


@pytest.mark.parametrize("crowd", [2, 8, 64])
def test_links_of_crowds(spark, crowd):
    rng = random.Random(crowd)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps = sorted(fps)
    want = brute_components(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from lumenlake.llm.components import components

    roots = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df, crowd)).collect()}
    got = [roots.get(f, ("own", f)) for f in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_duplicates(made(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {1, 2, 7} and {r.component_id for r in empty} == {1}
    assert simhash.near_duplicates(made(spark, [])).count() == 0


def test_sketch_of_table(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, "documents")), reverse=True)
    texts = dict(rows)
    following = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    edited = {i: t[: len(t) - len(t) // 2] + following[i][: len(t) // 2] for i, t in rows}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.translate(UP).split()] for i in range(max(1, len(w) - 4))}
    off = []
    for r in queries.op6_sketch(spark, SF).collect():
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), sha(edited[r.doc_id]))
        a = shingles(texts[r.doc_id])
        for near, b in ((r.near_edited, shingles(edited[r.doc_id])), (r.near_next, shingles(following[r.doc_id]))):
            off.append(abs(near - len(a & b) / len(a | b)))
            if len(a) <= 16 and len(b) <= 16:
                assert off[-1] < 1e-9
    assert np.mean(off) < 0.06


def test_sketch_of_awkward_rows(spark):
    rows = [(4, "a b c d e f"), (3, None), (2, "ü" * 9), (2, "a b c d e f"), (None, "last one"), (None, "last two"), (1, "x y z " * 30000)]
    for size in (1, 90_000, 1 << 27):
        own = sketch.with_next(made(spark, rows), ["text"], size).collect()
        assert len(own) == len(rows)
        assert sorted(str(r.text) for r in own) == sorted(str(r.next_text) for r in own)
        assert {r.next_text for r in own if r.doc_id == 4} == {None}
    assert sketch.edited_neighbours(made(spark, [])).count() == 0
    one = sketch.edited_neighbours(made(spark, [(1, "ab cd")])).collect()[0]
    assert one.edited == "ab ab" and one.n_chars == 5


def test_ranges_of_uneven_ids(spark):
    ids = [*range(300), 10**15, -(10**12), *[7] * 50, None, None]
    rows = [(i, f"text {i} {n}") for n, i in enumerate(ids)]
    for size in (1, 40, 1000):
        docs = made(spark, rows)
        ends = sketch.ranges_of(docs, size)
        placed = docs.select("doc_id", sketch.range_of(F.col("doc_id"), ends).alias("at")).collect()
        key = lambda i: (i is None, -(i or 0))
        assert [r.at for r in sorted(placed, key=lambda r: key(r.doc_id))] == sorted(r.at for r in placed)
        assert size > 1 or len({r.at for r in placed}) > 250
        own = sketch.with_next(docs, ["text"], size).collect()
        following = sorted(own, key=lambda r: key(r.doc_id))
        assert len(own) == len(rows) and sorted(r.text for r in own) == sorted(r.next_text for r in own)
        unique = [r for r in following if ids.count(r.doc_id) == 1]
        for r in unique:
            after = next((x for x in following if key(x.doc_id) > key(r.doc_id)), following[0])
            assert ids.count(after.doc_id) > 1 or r.next_text == after.text


def test_merged_sketches(spark):
    rng = random.Random(5)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=n)) for n in (900, 40))
    df = spark.createDataFrame([(a, b, f"{a} | {b}")], "a string, b string, c string")
    for c in "abc":
        df = sketch.sketched(df, c, f"s{c}")
    r = df.select(sketch.merged(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb", "sc", sketch.containment(F.col("sb"), F.col("sc")).alias("c")).first()
    assert set(r.m.hashes) <= set(r.sc.hashes) | set(r.sa.hashes) | set(r.sb.hashes)
    assert r.c > 0.9


def test_urls(spark):
    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].translate(UP), m[2]) if m else ("", "")

    def rule(h, p):
        fit = [(len(n + s), n + s, v) for v, n, s in urls.RULES if (h == n or h.endswith("." + n)) and p.startswith(s)]
        return max(fit)[1:] if fit else None

    odd = [None, "", "no scheme", "HTTP://EXAMPLE.Net", "http://x.example.net/en/?q#f", "://org/fr/", "ftp://a.org/fr/x?u=http://b/", "http://example.net/en", "http://net", "http://évil.net/", "http://casino.example.com/zz/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(list(enumerate(odd, 10**6)), "page_id long, url string"))
    got = urls.judged(pages.withColumn("token", F.lit("x"))).collect()
    assert len(got) == pages.distinct().count()
    for r in got:
        assert (r.host, r.path) == parts(r.url)
        want = rule(r.host, r.path)
        assert r.rule == (want and want[0])
        assert r.verdict in ("allow", "block") and (not want or r.verdict == want[1])
    assert urls.judged(pages.limit(0)).count() == 0


def test_mined_rules_by_count(spark):
    rows = urls.parsed(spark.read.parquet(f"{SF}/pages.parquet"))
    rows = [(r.tokens, r.label, r.given, r.page_id) for r in rows.withColumn("label", urls.labelled(rows)).collect()]
    found = urls.mined(spark.createDataFrame([r[:2] for r in rows], "tokens array<string>, verdict string"), 0.05, 0.6).collect()
    assert found
    for f in found:
        held = [r for r in rows if set(f.tokens) <= set(r[0])]
        agree = sum(label == f.verdict for _, label, _, _ in held)
        assert abs(agree / len(held) - f.confidence) < 1e-9 and abs(agree / len(rows) - f.support) < 1e-9
    # No url of the table has more tokens than mining looks at, so the same rules judge.
    assert max(len(r[0]) for r in rows) <= urls.MOST
    got = {r.page_id: r for r in urls.judged(spark.read.parquet(f"{SF}/pages.parquet"), support=0.05).collect()}
    for tokens, _, given, page in rows:
        fit = [(f.confidence, f.support, len(f.tokens), " ".join(f.tokens), f.verdict) for f in found if set(f.tokens) <= set(tokens)]
        assert got[page].verdict == (given.verdict if given else max(fit)[-1] if fit else urls.DEFAULT)
        assert given or got[page].mined_rule == (max(fit)[3] if fit else None)


def test_url_labels_of_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judged(pages, train=F.crc32("url") % 5 != 0).filter("rule IS NULL").filter(F.crc32("url") % 5 == 0).collect()
    bad = [r for r in got if set(re.split("[.-]", r.host)) & set(urls.SEEDS)]
    assert bad and np.mean([r.verdict == "block" for r in bad]) >= 0.9
    assert np.mean([r.verdict == "allow" for r in got if r not in bad]) > 0.95


def test_baskets_of_many_tokens(spark):
    rows = [(i, f"http://a-b-c-d-e-f.x{i % 2}.example.com/" + "/".join(f"s{j}" for j in range(20)) + "?" + "&".join(f"k{j}=1" for j in range(20))) for i in range(40)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), seeds=("x1",)).collect()
    assert len(got) == 40 and {r.page_id: r.verdict for r in got} == {i: "block" if i % 2 else "allow" for i in range(40)}
    parsed = urls.parsed(spark.createDataFrame(rows, "page_id long, url string")).first()
    assert {"segment:s19", "query:k19"} <= set(parsed.tokens)


def test_rules_of_long_urls_are_mined_whole(spark):
    # More tokens that tell as much as the one that says all: none is left out, whichever comes first by strength or name.
    rng = random.Random(8)
    rows = [([f"t{j}" for j in range(26) if rng.random() < 0.3 or (j > 23 and i % 2)], rng.choice(["block", "allow"])) for i in range(200)]
    rows = [(t, "block" if {"t24", "t25", "t3"} <= set(t) else v) for t, v in rows]
    baskets = spark.createDataFrame([(t[:11], v) for t, v in rows], "tokens array<string>, verdict string")
    known = lambda found: {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in found.collect()}
    grown, levelled = known(urls.mined(baskets, 0.04, 0.5)), known(urls.mined(baskets, 0.04, 0.5, most=0))
    assert len(grown) > 20 and grown == levelled
    whole = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = known(urls.mined(whole, 0.05, 0.9))
    held = [v for t, v in rows if {"t24", "t25", "t3"} <= set(t)]
    assert max(len(t) for t, _ in rows) > urls.MOST
    assert any(set(k) <= {"t24", "t25", "t3"} and v == "block" for k, v in got) and len(held) >= 10
    for (tokens, verdict), (sure, share) in got.items():
        own = [v for t, v in rows if set(tokens) <= set(t)]
        assert abs(own.count(verdict) / len(own) - sure) < 1e-6 and abs(own.count(verdict) / len(rows) - share) < 1e-6
    pages = spark.createDataFrame([(i, "u", t, v) for i, (t, v) in enumerate(rows)], "page_id long, url string, tokens array<string>, verdict string")
    mined_from = urls.mining_baskets(pages, urls.telling(pages, 0.01)).collect()
    assert sorted(tuple(r.tokens) for r in mined_from) == sorted(tuple(sorted(t)) for t, _ in rows if t)
