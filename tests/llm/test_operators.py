"""Each operator against a plain version in Python, on small made-up tables and on the smallest data."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, langid, line_dedup, mixing, quality_fm, queries, sentencepiece_viterbi, substring_dedup, topk_search, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, place int, key string, n int"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=5):
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts, repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))
    passage, base, lines = text(60), text(120), "\n".join(text(6).replace("\n", " ") for _ in range(12))
    rows = [text(rnd.randrange(0, 90)) for _ in range(60)]
    rows += [text(20) + passage + text(rnd.randrange(30)) for _ in range(12)]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [base] * 7 + [base.upper()] * 2 + [passage + passage]
    rows += [text(5) + "\n" + "\n".join(lines.split("\n")[rnd.randrange(4) :]) for _ in range(6)]
    rows += ["a\na\na\na\na\na\na", "x\ny\nz\nx\ny\nz", "one two three", "one two  three", "one", "", "", None, None, " \n", "word " * 100, text(30_000)]
    rnd.shuffle(rows)
    out = [(i * 3, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "S3", None]), len(t or ""), "m", 1, "k", 2) for i, t in enumerate(rows)]
    return [*out, out[4], out[5], (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(pairs):
    ids = [i for i, _ in pairs]
    sets = [s for _, s in pairs]
    up = list(range(len(pairs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(pairs)):
        groups[top(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[top(i)]) if sets[i] and ids[i] is not None else ids[i], links[i]) for i in range(len(pairs))]


def same(left, right):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)


def test_jaccard_components(docs, rows, empty, small, spark):
    found = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    same(found, brute_components([(r[0], shingle_set(r[1])) for r in rows]))
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_jaccard_large_family_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(60)] = f"v{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    same(found, brute_components([(i, shingle_set(t)) for i, t in rows]))


def test_jaccard_family_in_tiers_of_size(spark, monkeypatch):
    """Texts that grow out of one another: a family of all sizes, of which only near ones may link."""
    rnd = random.Random(12)
    long = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(long[: rnd.randrange(20, 400)])) for i in range(160)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 1500)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    same(found, brute_components([(i, shingle_set(t)) for i, t in rows]))


def test_jaccard_blocks_meet_where_sizes_allow(spark, monkeypatch):
    from tessera.sources.scratch import Scratch

    def dealt(n, grams):
        sizes = F.greatest(F.lit(20), F.pmod(F.xxhash64("id"), F.lit(2000))).cast("long")
        placed = spark.range(n).select(F.lit(7).cast("long").alias("family"), F.col("id").alias("node"), sizes.alias("size"), F.lit(1).cast("long").alias("copies"))
        ended = jaccard_join._with_ends(placed, jaccard_join.Bounds(75), Scratch(spark, "test"))
        return ended, jaccard_join._dealt(ended.withColumn("grams", F.lit(b"")))

    # one family of 20,000 sets: rows shipped against what a meeting of all blocks would ship
    _, rows = dealt(20_000, None)
    grams = 20_000 * 1000
    assert rows.count() < 0.55 * 20_000 * grams / jaccard_join.BLOCK_GRAMS
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 4000)
    ended, rows = dealt(300, None)
    size = {r.node: r["size"] for r in ended.select("node", "size").collect()}
    tasks = defaultdict(lambda: ([], []))
    for r in rows.select("task", "side", "alone", "node").collect():
        tasks[(*r.task, r.alone)][r.side].append(r.node)
    met = Counter()
    for task, (left, right) in tasks.items():
        for i, a in enumerate(left):
            for b in left[i + 1 :] if task[-1] else right:
                met[frozenset((a, b))] += 1
    assert all(n == 1 for n in met.values())
    assert all(frozenset((a, b)) in met for a in size for b in size if a < b and 100 * min(size[a], size[b]) >= 75 * max(size[a], size[b]))


def test_jaccard_product():
    import numpy as np

    rnd = random.Random(3)
    sets = [np.unique(np.array([rnd.randrange(40) for _ in range(rnd.randrange(20, 40))], np.uint64)) for _ in range(30)]
    bounds = jaccard_join.Bounds(60)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(set(a) & set(b)) >= 60 * len(set(a) | set(b))}
    assert want and {(i, int(j)) for i, at in jaccard_join.product(sets, None, bounds) for j in at} == want
    assert {(i, int(j) + 12) for i, at in jaccard_join.product(sets[:12], sets[12:], bounds) for j in at} == {(i, j) for i, j in want if i < 12 <= j}


def test_jaccard_identifier_on_different_texts(spark):
    rnd = random.Random(6)
    shared = [f"w{i}" for i in range(30)]
    bases = [shared + [f"b{n}x{i}" for i in range(12)] for n in range(4)]
    rows = []
    for _ in range(80):
        w = list(rnd.choice(bases))
        w[rnd.randrange(len(w))] = f"v{rnd.randrange(20)}"
        rows.append((rnd.randrange(12), " ".join(w)))
    rows += [(1, " ".join(bases[0])), (1, " ".join(bases[1])), (2, " ".join(bases[0])), (50, "alone in the corpus with these words")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    same(found, brute_components([(i, shingle_set(t)) for i, t in rows]))


def test_jaccard_on_data(spark, small):
    rows = [(r.doc_id, shingle_set(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    same(queries.op2_jaccard_join(spark, small).select("doc_id", "n_shingles", "component_id", "n_links").collect(), brute_components(rows))


def brute_repeats(texts, window):
    where = Counter()
    split = [words(t) for t in texts]
    for w in split:
        where.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_substring_dedup(docs, rows, empty, spark, small):
    sha = F.sha2("text", 256)
    found = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", sha).collect()
    same(found, [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 35), strict=True)])
    assert substring_dedup.remove_repeats(empty).collect() == []
    for group in (1, 4):  # longer prefixes, and whole windows where those are crowded too
        again = substring_dedup.remove_repeats(docs, group=group).select("doc_id", "n_words", "n_removed", sha).collect()
        same(again, [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 35), strict=True)])
    data = spark.read.parquet(f"{small}/documents.parquet").collect()
    same(queries.op3_substring_dedup(spark, small).collect(), [(r.doc_id, *x) for r, x in zip(data, brute_repeats([r.text for r in data], 35), strict=True)])


def test_substring_trees_over_shared_parts(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        a = rnd.randrange(80)
        part = base[a : a + rnd.randrange(20, 60)]
        rows.append((i, " ".join([f"x{rnd.randrange(9999)}" for _ in range(rnd.randrange(9))] + part + [f"y{rnd.randrange(9999)}" for _ in range(rnd.randrange(9))])))
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 35), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (1, 8, 30, 8192):
        same(substring_dedup.remove_repeats(docs, group=group).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect(), want)


def line_windows(text, run, heavy):
    """(start, lines) of all runs: of ``run`` lines, a whole shorter text with a word, and single lines of many words."""
    lines = text.split("\n")
    found = {(s, tuple(lines[s : s + run])) for s in range(len(lines) - run + 1)}
    if len(lines) < run and words(text):
        found.add((0, tuple(lines)))
    return found | {(i, (x,)) for i, x in enumerate(lines) if len(words(x)) >= heavy}


def brute_lines(rows, run=3, heavy=50):
    """rows: (doc_id, text). First places by (null last, doc_id, text) order."""
    first = {}
    for me in sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}):
        for s, w in sorted(line_windows(me[2], run, heavy)):
            first.setdefault(w, (me, s))
    for i, t in rows:
        if t is None:
            yield i, 0, None
            continue
        me, gone = (i is None, i or 0, t), set()
        for s, w in line_windows(t, run, heavy):
            at, begin = first[w]
            if at != me or s - begin >= len(w):
                gone.update(range(s, s + len(w)))
        yield i, len(gone), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def test_line_dedup(docs, rows, empty, spark, small):
    found = line_dedup.dedup_lines(docs, count_col="deleted")
    assert found.columns == [*docs.columns, "deleted"]
    same(found.select("doc_id", "deleted", "text").collect(), brute_lines([(r[0], r[1]) for r in rows]))
    assert line_dedup.dedup_lines(empty).collect() == []
    data = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    same(line_dedup.dedup_lines(data, count_col="n").select("doc_id", "n", "text").collect(), brute_lines([tuple(r) for r in data.collect()]))
    shared = " ".join(f"w{i}" for i in range(51))
    texts = [f"one\n{shared}\ntwo", f"a\nb\nc\n{shared}", "short\ntext", "short\ntext", "short\ntext\nmore", shared, "", "", " ", " "] + ["x\ny\nz\nx\ny\nz\ny"] * 2
    more = [(i, t) for i, t in enumerate(texts)]
    found = line_dedup.dedup_lines(spark.createDataFrame(more, "doc_id long, text string"), count_col="n").select("doc_id", "n", "text").collect()
    same(found, brute_lines(more))
    assert [r.n for r in sorted(found)][:10] == [0, 1, 0, 2, 0, 1, 0, 0, 0, 0]


def test_exact_dedup(docs, rows, empty, spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(r[0], keep[t], len(groups[t]), r[0] == keep[t], hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [norm(r[1])]]
    same(exact_dedup.exact_dedup(docs).collect(), want)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_of_copies_over_many_partitions(spark):
    texts = ["the same text " * 9, "the same text " * 9 + "x", "", None, "other"]
    rows = [(i * 7 % 3001, texts[0] if i % 3 else texts[i // 3 % 5]) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    same(found, [(i, min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows for g in [groups[norm(t)]]])


def test_exact_dedup_when_hashes_collide():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["doc_id", "norm", "hash"])

    rows = [(1, "a", 5), (2, "a", 5), (1, "b", 5), (3, "c", 6), (4, "d", 7), (5, "d", 7), (1, "e", 7), (9, "e", 7)]
    for cut in range(len(rows) + 1):
        out = [r for b in exact_dedup._runs(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        runs = [(r["run"], r["doc_id"], r["size"], r["edge"]) for r in out if r["size"]]
        assert sorted(runs) == [(0, 1, 2, "a"), (1, 1, 1, "b"), (2, 3, 1, None), (3, 4, 2, "d"), (4, 1, 2, "e")]
        assert [r["run"] for r in out if not r["size"]] == [0, 0, 1, 2, 3, 3, 4, 4]


def brute_targets(sizes, budget=1.5, cap=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def test_mixing(docs, rows, empty, spark):
    found = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(sizes)
    assert len(found) == len(rows)
    by_id = {}
    taken = Counter()
    source_of = {(r[0], len(words(r[1]))): r[3] for r in rows}
    for r in found:
        source = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source], rel=1e-12)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert by_id.setdefault(r.doc_id, r.copies) == r.copies or r.doc_id is None
        taken[source] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)
    same(mixing.mix_report(docs).collect(), found)
    assert mixing.mix_report(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mixing_comes_near_its_targets(spark, small):
    sf = small.replace("0.001", "0.01")
    found = queries.op9_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    sizes = {r.source: r.n for r in found.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = brute_targets(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in found.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert r.t == pytest.approx(targets[r.source], rel=1e-12) and abs(r.n / r.t - 1) < 0.35


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark, small):
    urls = [r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    urls += [None, "", "no-scheme", "http://", "http://COM/x", "http://com", "http://example.com/en/", "HTTP://WWW.Example.com/en/a?b#c", "http://notexample.com/en/", "http://a.net/es/1", "http://net/es", "http://x.net/fr/\n2", "http://a..com/é", "ftp://u@example.com:80/en/", "a://b://c.com/"]
    rows = [(i, u, "k", "h") for i, u in enumerate([*urls, *urls[:2]])]
    found = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, key string, host string"), queries.RULES)
    same(found.collect(), [(i, *brute_rule(u)) for i, u, _, _ in rows])
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES).collect() == []


def test_url_rules_as_a_table_and_beyond_what_is_sent(spark, monkeypatch):
    rules = [("block" if i % 3 else "allow", f"h{i % 200}.com", f"/{'ab'[i % 2]}{i // 200}/") for i in range(900)]
    rows = [(i, f"http://{'www.' * (i % 2)}h{i % 250}.com/{'ab'[i % 2]}{i % 7}/x") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "verdict string, host string, path string").repartition(2)
    want = []
    for i, u in rows:
        _, _, host, path = u.split("/", 3)
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        want.append((i, host, f"/{path}", max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"))
    same(url_filter.filter_urls(pages, table).collect(), want)
    monkeypatch.setattr(url_filter, "MAX_BITS", 1000)
    same(url_filter.filter_urls(pages, table).collect(), want)
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    from tessera.sources.scratch import Scratch

    universe = spark.range(20_000).selectExpr("concat('key', id) key")
    listed = spark.range(300).selectExpr("concat('key', id * 31) key")
    cascade = url_filter.build_cascade(universe, listed, Scratch(spark, "test"), "c")
    assert len(cascade.levels) > 2
    found = cascade.attach(universe).where(cascade.listed(F.col("key"))).select("key")
    same(found.collect(), listed.collect())


def test_top_k(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)], "x", 1) for i in range(400)]
    rows += [(i, [0.5] * 8, "x", 1) for i in range(400, 460)]  # ties
    rows += [(460, None, "x", 1), (461, [0.1] * 7 + [None], "x", 1), (480, [float("nan")] * 8, "x", 1), (500, [1.0] * 3, "x", 1), (None, [0.5] * 8, "x", 1), (520, [], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string, block int").repartition(3)
    ints = {r.vec_id: [int(__import__("math").floor(64 * x)) for x in r.embedding] for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and x == x for x in r.embedding)}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    same(topk_search.top_k(df, lambda c: c % 20 == 0, block=64, query_block=7).collect(), want)
    assert topk_search.top_k(df.limit(0), lambda c: c % 20 == 0).collect() == []
    few = df.where("vec_id in (0, 1, 2)")
    assert topk_search.top_k(few, lambda c: c % 20 == 0).count() == 2


def test_top_k_of_repeated_identifiers(spark):
    rnd = random.Random(8)
    rows = [(i % 70, [float(rnd.randrange(-3, 4)) for _ in range(4)]) for i in range(300)]
    rows += [(0, rows[0][1]), (1, [1e30] * 4), (2, [2.0**23] * 4)]  # the last fits, the one before does not
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scores = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n and w[0] < 1e20)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    same(topk_search.top_k(df, lambda c: c % 20 == 0, block=50, query_block=6).collect(), want)
    four = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [2.0]), (2, [1.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(four, lambda c: c == 0).orderBy("rank").collect()] == [(1, 8192), (1, 4096), (2, 4096), (2, 2048)]


def test_top_k_of_equal_vectors_passes_no_ties_on(spark):
    df = spark.range(6_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5)] * 4).alias("embedding"))
    out = topk_search.scored(df, lambda c: c % 20 == 0, 20, 64.0, "vec_id", "embedding", 500, 64)
    assert out.count() <= 300 * 20 * 2  # the first block's, and no block's ties beside them
    found = topk_search.top_k(df, lambda c: c % 20 == 0, block=500, query_block=64)
    same([tuple(r) for r in found.where("query_id = 40").collect()], [(40, i + 1, i, 4096) for i in range(20)])


def test_language_id(docs, rows, empty, spark, small):
    found = langid.identify(docs, F.lit(False)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    none = {r[0] for r in rows if not any(map(str.isalpha, r[1] or ""))}
    assert {r.doc_id for r in found if r.lang_pred == "und"} == none
    assert langid.identify(empty, F.lit(False)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled, F.lit(False)).collect()} == {"und"}
    sf = small.replace("0.001", "0.01")
    told = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)


def plain_letters(text):
    return " ".join(re.findall(r"[^\W\d_]+", text or "")).lower()


def plain_ranks(counts, size):
    order = sorted(counts, key=lambda g: (-counts[g], len(g), g))
    return {g: i for i, g in enumerate(order[:size])}


def plain_grams(text):
    s = f" {plain_letters(text)} "
    return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if not (n == 1 and s[i] == " "))


def plain_language(rows, texts, size=langid.PROFILE):
    """Out-of-place distances from dictionaries. rows: (text, lang) to learn from. Ties of n-grams go to the shorter,
    then to the smaller by code points; ties of languages to the first."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None and any(map(str.isalpha, text or "")):
            counts[lang] += plain_grams(text)
    profiles = {lang: plain_ranks(c, size) for lang, c in sorted(counts.items())}
    for t in texts:
        if not profiles or not any(map(str.isalpha, t or "")):
            yield "und", 0.0
            continue
        own = plain_ranks(plain_grams(t), size)
        off = {lang: sum(abs(p[g] - i) if g in p else size for g, i in own.items()) for lang, p in profiles.items()}
        best = min(off, key=lambda lang: (off[lang], lang))
        yield best, 1 - off[best] / (size * len(own))


def test_language_id_against_plain_distances(spark, docs, rows, small):
    ties = [(1000 + i, t, lang, "s", 0) for i, (t, lang) in enumerate([("ab ab", "xx"), ("ab ab", "ww"), ("zz zz", "yy"), ("ab", None), ("zz", None), ("ab zz", None), ("\U0001d4d0 é É", None), ("1 2 _", None)])]
    for table in (docs.select("doc_id", "text", "lang"), spark.createDataFrame(ties, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{small}/documents.parquet")):
        data = table.select("doc_id", "text", "lang").collect()
        found = langid.identify(table, F.lit(False)).collect()
        want = list(plain_language([(r.text, r.lang) for r in data], [r.text for r in data]))
        same([(r.doc_id, r.lang_pred, round(r.score, 9)) for r in found], [(r.doc_id, lang, round(score, 9)) for r, (lang, score) in zip(data, want, strict=True)])


def test_language_id_learns_a_rare_language_of_copies(spark):
    many = spark.range(40_000).select(F.concat(F.lit("the house and the garden "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    for text in ("zwölf böse füchse", "über größe und öl", "süße äpfel für jörg", "schöne grüße"):
        rare = spark.createDataFrame([(text, "de")] * 5, "text string, lang string")
        assert langid.learn_profiles(many.unionByName(rare)).languages == ["de", "en"]


def test_quality(docs, rows, empty, spark, small):
    labels = spark.createDataFrame([(r[0], int((r[0] or 0) % 2), 0) for r in rows[:80]] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    found = quality_fm.classify(docs, labels, F.lit(False)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert {r.score for r in quality_fm.classify(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert quality_fm.classify(empty, labels, F.lit(False)).collect() == []
    sf = small.replace("0.001", "0.1")
    told = queries.op5_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in told if r.quality], [r.score for r in told if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8


def test_factorisation_machine_against_all_pairs(rows):
    import numpy as np

    rng = np.random.default_rng(5)
    texts = pa.array([r[1] for r in rows])
    meta = np.array([float(r[4] or 0) for r in rows])
    bounds, buckets, weights, stats = quality_fm.features(texts, meta)
    machine = quality_fm.fit(bounds, buckets, weights, stats, rng.integers(0, 2, len(rows)).astype(float), epochs=2)
    row, index, value = machine.inputs(bounds, buckets, weights, stats)
    scores = machine.score(texts, meta)
    for i in range(0, len(rows), 7):
        own = np.flatnonzero(row == i)
        if len(own) > 2000:
            continue
        total = machine.bias + (machine.linear[index[own]] * value[own]).sum()
        for a in range(len(own)):
            va = machine.factors[index[own[a]]] * value[own[a]]
            for b in range(a):
                total += float(va @ machine.factors[index[own[b]]]) * value[own[b]]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-9)


def test_quality_of_repeated_rows_and_null_metadata(spark):
    texts = [(i, f"good words number {i} " * 5 if i % 2 else f"bad $$$ {i} " * 5, None if i % 3 else 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    once = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    many = spark.createDataFrame(texts + [texts[3]] * 50, "doc_id long, text string, n_chars long")
    scores = {r.doc_id: r.score for r in quality_fm.classify(once, labels, F.lit(False)).collect()}
    found = quality_fm.classify(many, labels, F.lit(False)).collect()
    assert len(found) == 110 and all(r.score == pytest.approx(scores[r.doc_id]) for r in found)


def test_sentencepiece_against_the_library(spark, docs, rows, empty):
    sp = pytest.importorskip("sentencepiece")
    path = queries.piece_model_path()
    model, library = sentencepiece_viterbi.Model.read(path), sp.SentencePieceProcessor(model_file=path)
    more = ["", " ", " " * 15 + "x", "\t\n 執執 한국어 😀😀 ünï", "x" * 300, "a   b    int main()  {\n    return 0;\n}", "   lead", "trail   "]
    more += [" " * n + t + " " * (n % 7) for n in range(40) for t in ("the", "漢", "\n", "")]
    rnd = random.Random(1)
    more += ["".join(rnd.choice("abcdeé \n  ß漢.,'") for _ in range(rnd.randrange(90))) for _ in range(300)]
    texts = [r[1] for r in rows] + more
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = df.select("doc_id", "text", sentencepiece_viterbi.encode(F.col("text"), model).alias("out"))
    found = found.withColumn("back", sentencepiece_viterbi.decode(F.col("out"), model)).collect()
    for r in found:
        assert r.out == (None if r.text is None else library.encode(r.text)), r.text
        assert r.back == r.text
    assert empty.select(sentencepiece_viterbi.encode(F.col("text"), model)).collect() == []


def test_sentencepiece_unigram_reaches_the_best_score():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece as sp

    proto = pb.ModelProto()
    proto.ParseFromString(open(queries.piece_model_path(), "rb").read())
    proto.trainer_spec.model_type = 1
    rnd = random.Random(3)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -rnd.uniform(4, 14)
    raw = proto.SerializeToString()
    model, library = sentencepiece_viterbi.Model.parse(raw), sp.SentencePieceProcessor(model_proto=raw)
    texts = ["hello world, this is it", "漢字 x y", "a" * 90, "  two  spaces "] + ["".join(rnd.choice("abcde fgh.,") for _ in range(60)) for _ in range(100)]
    score = lambda ids: sum(float(model.scores[i]) for i in ids)
    for ours, theirs in zip(model.encode(pa.array(texts), sentencepiece_viterbi.Memory()).to_pylist(), library.encode(texts), strict=True):
        assert score(ours) == pytest.approx(score(theirs), abs=1e-3)
