"""Near-duplicates, line dedup, quality, mixing, packing and rollups against brute force and held-out labels."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import lines, mixing, neardup, packing, quality, rollups
from marketloom.llm.common import Scratch, components
from marketloom.llm.tokens import bpe, public_path

BPE = public_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed, n=60, words=80):
    """Bases with edited copies, exact copies, and unrelated texts."""
    rnd, vocab = random.Random(seed), [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 12, words, words * 3]))]
        out.append(base)
        for _ in range(rnd.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append(copy)
    rnd.shuffle(out)
    return [(k, " ".join(w).title() if k % 7 == 0 else " ".join(w)) for k, w in enumerate(out)]


def shingled(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rows = corpus(words) + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE TWO"), (905, "x " * 3000), (906, "x " * 3001)]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows), words, percent).collect()}
    sets = {i: shingled(t, words) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    assert len(set(want.values())) < len(want) - 20
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_find_links_that_stars_miss(spark):
    """Edited copies whose base isn't the smallest id: most aren't like one another."""
    rnd = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(80):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(120)] = f"e{rnd.random()}"
        texts.append(" ".join(copy))
    rows = [*enumerate(texts), (500, " ".join(base))]
    got = {r.component_id for r in neardup.near_duplicates(docs(spark, rows), 3, 85, block_shingles=4000).collect()}
    sets = {i: shingled(t, 3) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == set(union(pairs, sets).values())


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    df = docs(spark, rows).withColumn("component_id", F.lit(7)).withColumn("keys", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=repr)
    assert neardup.near_duplicates(df.where("false")).count() == 0
    assert neardup.keep_one(df).columns == df.columns and neardup.keep_one(df).count() == 3


def test_signature_bands_are_alike_as_often_as_sets():
    rnd = np.random.default_rng(0)
    made, same = neardup.Signatures(20, 5), []
    for _ in range(40):
        common = np.unique(rnd.integers(0, 2**63, 80, dtype=np.uint64))
        a, b = (np.union1d(common, rnd.integers(0, 2**63, 10, dtype=np.uint64)) for _ in "ab")
        same.append((made.bins(a) == made.bins(b)).mean())
    assert np.mean(same) == pytest.approx(0.8, abs=0.04)
    assert (made.bins(np.array([5], np.uint64)) == 5).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    assert got == union(edges, nodes | {5}) | {} or got == {n: c for n, c in union(edges, nodes | {5}).items() if n in nodes}


def line_model(rows, least=10, size=5, percent=80):
    places, sets = defaultdict(list), {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                places[x].append((i, p))
                sets[x] = {x[k : k + size] for k in range(len(x) - size + 1)}
    names = list(sets)
    pairs = [(a, b) for a in names for b in names if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for x, c in union(pairs, names).items():
        groups[c] += places[x]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in rows}, len(pairs)


def test_line_dedup_against_brute_force(spark):
    rnd, rows, pool = random.Random(4), [], []
    alphabet = "abcdefghiklmnoprstu "
    for i in range(100):
        own = []
        for _ in range(rnd.randint(0, 6)):
            if pool and rnd.random() < 0.5:
                line = list(rnd.choice(pool))
                for _ in range(rnd.choice([0, 0, 1, 2])):
                    line[rnd.randrange(len(line))] = rnd.choice("xyz")
                own.append("".join(line))
            else:
                own.append("".join(rnd.choice(alphabet) for _ in range(rnd.choice([5, 12, 60, 200, 400]))))
                pool.append(own[-1])
        rows.append((i, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n")]
    want, links = line_model(rows)
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert links > 30
    texts = dict(rows)
    same = sum(got[i].text == (want[i] if texts[i] is not None else None) for i in want)
    assert same >= len(want) - 2  # bands may miss a pair near the threshold
    assert all(got[i].n_lines == (len(texts[i].split("\n")) if texts[i] is not None else 0) for i in want)


def test_line_dedup_finds_what_stars_miss(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefghijklmno ") for _ in range(300))
    rows = []
    for i in range(40):
        x = list(base)
        for _ in range(4):
            x[rnd.randrange(300)] = rnd.choice("XYZ")
        rows.append((i, "".join(x)))
    rows.append((77, base))
    want, _ = line_model(rows)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows), block=8).collect()}
    assert sum(got[i] == want[i] for i in want) >= len(want) - 1


def shared_keys(spark, pairs):
    """Whether the two lines of each pair share a bucket key."""
    rows = [(2 * k + j, x) for k, pair in enumerate(pairs) for j, x in enumerate(pair)]
    df = docs(spark, rows)
    signed = lines.lines_of(df, 10).select("doc_id", "node").join(lines.signed_lines(df, 10, 5), "node")
    got = {r.doc_id: set(r["keys"]) for r in signed.collect()}
    return [bool(got[2 * k] & got[2 * k + 1]) for k in range(len(pairs))]


def jaccard(a, b, size=5):
    a, b = ({x[k : k + size] for k in range(len(x) - size + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_line_keys_miss_no_pair_at_the_threshold(spark):
    rnd, pairs, alphabet = random.Random(12), [], "abcdefghiklmnoprstu "
    while len(pairs) < 3000:
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([12, 20, 30, 38, 45, 60, 90, 150, 300])))
        b = list(a + "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 0, 1, 2, len(a) // 6]))))
        for _ in range(rnd.choice([0, 1, 1 + len(a) // 60, 1 + len(a) // 50])):
            b[rnd.randrange(len(b))] = "X"
        if a != (b := "".join(b)) and 0.8 <= jaccard(a, b) < 0.86:
            pairs.append((a, b))
    found = shared_keys(spark, pairs)
    assert sum(found) >= len(found) - 1  # at 1e-5 a pair, even one miss in 3,000 has a chance of 3 percent


def test_line_keys_join_lines_written_twice_and_lines_at_the_border(spark):
    rnd, pairs, alphabet = random.Random(5), [], "abcdefghiklmnoprstu "
    while len(pairs) < 1000:
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(50, 70) if len(pairs) < 600 else rnd.randint(34, 46)))
        b = f"{a} | {a}" if len(pairs) < 600 else a + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9)))
        if jaccard(a, b) >= 0.8:
            pairs.append((a, b))
    assert all(shared_keys(spark, pairs))


def test_line_dedup_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (1, line), (1, line), (2, f"{line}\nshort\n{line}"), (3, line)]
    df = docs(spark, rows).withColumns({c: F.lit(k) for k, c in enumerate(["gone", "node", "document", "row", "version", "n_lines", "n_kept", "lost"])})
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(None, line, 1, 1), (1, line, 1, 1), (1, line, 1, 1), (2, "short", 3, 1), (3, "", 1, 0)], key=repr)
    assert sorted((r.doc_id is None, r.doc_id) for r in lines.keep_first_lines(df).select("doc_id").collect() if r.doc_id) == [(False, 1), (False, 1), (False, 2)]
    kept = lines.keep_first_lines(df)
    assert kept.columns == df.columns and {(r.gone, r.n_lines, r.n_kept) for r in kept.collect()} == {(0, 5, 6)}
    assert lines.dedup_lines(docs(spark, []).where("false")).count() == 0


def test_line_dedup_keeps_lines_of_other_texts_of_one_id(spark):
    one, other = "the first line, which stands once only", "another line, which both texts have"
    rows = [(7, f"{one}\n{other}"), (7, f"{other}\n{other}\nand a line of the second text alone"), (7, "12345 67890 abcde fghij klmno")]
    texts = [r.text for r in lines.dedup_lines(docs(spark, rows)).collect()]
    held = "\n".join(texts).split("\n")
    assert sorted(held) == sorted([one, other, "and a line of the second text alone", rows[2][1]])


def test_quality_learns_without_negatives(spark):
    root = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{root}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{root}/labels.parquet")
    got = quality.classify(documents, labels, bound=2000)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == documents.count()
    rows = got.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted == 0 for r in bad]) > 0.9


def test_quality_prior_needs_no_negatives(spark):
    root = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    share = labels.where("quality IS NOT NULL").agg(F.avg("quality")).first()[0]
    _, prior = quality.train(documents, labels.where("quality = 1"))
    assert prior == pytest.approx(share, abs=0.06)
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(2, 1, (4000, 3)), rnd.normal(-2, 1, (4000, 3))
    for wanted in (0.2, 0.5, 0.8):
        mixed = np.vstack([good[2000 : 2000 + int(2000 * wanted)], bad[: 2000 - int(2000 * wanted)]])
        assert quality.estimated_prior(good[:2000], rnd.permutation(mixed)) == pytest.approx(wanted, abs=0.07)


def test_quality_slopes_are_those_of_the_risk():
    rnd = np.random.default_rng(5)
    p, u, w, b = rnd.normal(1, 1, (30, 4)), rnd.normal(0, 1, (50, 4)), rnd.normal(size=4), 0.3
    log1 = lambda z: np.log1p(np.exp(z))

    def bracket(x, prior):
        return log1(u @ x[:-1] + x[-1]).mean() - prior * log1(p @ x[:-1] + x[-1]).mean()

    for prior in (0.1, 0.9):
        whole = lambda x: prior * log1(-(p @ x[:-1] + x[-1])).mean() + bracket(x, prior)
        x = np.append(w, b)
        risk = whole if bracket(x, prior) >= 0 else lambda y: -bracket(y, prior)
        for k in range(5):
            e = np.eye(5)[k] * 1e-6
            assert quality.slopes(p, u, prior, w, b)[k] == pytest.approx((risk(x + e) - risk(x - e)) / 2e-6, abs=1e-5)
    least = quality.fit(p, u, 0.4)
    z = [np.clip((x - least.mean) / least.scale, -6, 6) @ least.weights + least.bias for x in (p, u)]
    total = lambda a, c: 0.4 * log1(-a).mean() + max(0, log1(c).mean() - 0.4 * log1(a).mean())
    assert total(*z) < total(np.zeros(30), np.zeros(50))


def test_quality_odd_rows(spark):
    rows = docs(spark, [(1, None), (2, ""), (None, "some text"), (2, ""), (3, "x" * 200_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(rows, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.classify(rows, some).collect())
    assert quality.keep_good(rows, some).columns == rows.columns
    assert quality.classify(rows.where("false"), none).count() == 0


def test_raking_meets_its_targets():
    rnd = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}") for a in range(5) for b in range(3) for c in range(4)]
    tokens = rnd.integers(1000, 100_000, len(cells)).astype(float)
    targets = {"source": {f"s{k}": 1.0 for k in range(5)}, "lang": {"l0": 2, "l1": 1, "l2": 1}, "topic": {f"t{k}": 1 for k in range(4)}}
    x = mixing.rake(cells, tokens, 0.1, targets, 60)
    by = lambda k: {v: sum(w for c, w in zip(cells, x) if c[k] == v) / x.sum() for v in {c[k] for c in cells}}
    assert max(abs(v - 0.2) for v in by(0).values()) < 0.01 and by(1)["l0"] == pytest.approx(0.5, abs=0.01)
    assert (x <= tokens).all()


def test_buckets_with_common_lines_are_one(spark, tmp_path):
    from marketloom.llm.common import Scratch

    near = [(key, node, 1, node) for key in range(19) for node in range(100) if (key + node) % 19]
    chain = [(1000 + k, 5000 + 40 * k + j, 1, 5000 + 40 * k + j) for k in range(30) for j in range(50)]
    large = spark.createDataFrame(near + chain, "key long, node long, sketch long, component long")
    got = lines.merged(large, Scratch(spark, "merged")).collect()
    one, apart = [r for r in got if r.node < 5000], [r for r in got if r.node >= 5000]
    assert len(one) == 100 and len({r.key for r in one}) == 1  # 1,795 rows before
    assert sorted((r.key, r.node) for r in apart) == sorted((k, n) for k, n, _, _ in chain)


def test_sets_are_shuffled_once_to_confirm_pairs(spark, tmp_path):
    rows = [(k, list(range(k % 7, 40 + k % 7))) for k in range(300)]
    spark.createDataFrame(rows, "node long, s array<int>").write.parquet(f"{tmp_path}/sets")
    spark.createDataFrame([(k, k + 7 * j) for k in range(100) for j in (1, 5)] + [(k, k + 1) for k in range(50)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = lines.confirmed(spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/sets"), 99)
        assert {(r.a, r.b) for r in got.collect()} == {(k, k + 7 * j) for k in range(100) for j in (1, 5)}
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parities_settle_most_unlike_pairs_and_no_like_one(spark):
    rnd, sets, like = random.Random(3), {}, {}
    for k in range(300):
        n, shift = rnd.choice([5, 40, 300, 450, 2000]), rnd.choice([0.02, 0.1, 0.11, 0.12, 0.2, 0.3, 0.5])
        x = rnd.sample(range(-(2**31), 2**31), n + int(n * shift))
        sets[2 * k], sets[2 * k + 1] = x[:n], x[len(x) - n :]
        like[2 * k, 2 * k + 1] = 100 * len({*sets[2 * k]} & {*sets[2 * k + 1]}) >= 80 * len(x)
    both = spark.createDataFrame([*sets.items()], "node long, s array<int>")
    bits = lines.parities(both)
    assert {r.node: r["size"] for r in bits.collect()} == {k: len(x) for k, x in sets.items()}
    pairs = spark.createDataFrame([*like], "a long, b long")
    left = {(r.a, r.b) for r in lines.not_unlike(pairs, bits, 80).collect()}
    want = {x for x, y in like.items() if y}
    assert len(want) > 50 and want <= left
    assert sum(x in left for x, y in like.items() if not y) < 0.6 * (len(like) - len(want))
    assert {(r.a, r.b) for r in lines.confirmed(pairs, both, 80).collect()} == want


def test_line_keys_are_shuffled_once_and_unlike_sets_not_at_all(spark, monkeypatch):
    from marketloom.llm.common import Scratch

    exchanges, pairs, write, compare = {}, [], Scratch.table, lines.confirmed

    def table(self, df, name):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key")
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    monkeypatch.setattr(lines, "confirmed", lambda x, *a: pairs.append(x.count()) or compare(x, *a))
    rnd, rows = random.Random(6), []
    for i in range(60):  # of each base line one that is like it, and some just under the threshold
        base = "".join(rnd.choice("abcdefghijklmno ") for _ in range(300))
        for j, edits in enumerate((0, 3, 9, 10, 10, 11)):
            x = list(base)
            for p in rnd.sample(range(300), edits):
                x[p] = "X"
            rows.append((6 * i + j, "".join(x)))
    want, _ = line_model(rows)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert sum(got[i] == want[i] for i in want) >= len(want) - 2
    assert [n for x, n in exchanges.items() if x.startswith("shared-")] == [1, 1, 1]
    assert pairs[1] < 60  # of the pairs that share keys


def test_line_dedup_holds_no_shuffle_of_texts_while_sets_are_compared(spark, monkeypatch):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {int(k) for k in re.findall(r"shuffle_(\d+)_", files)}

    last, held, compare = max(shuffles(), default=-1), [], lines.confirmed

    def watched(*a):
        for _ in range(50):  # files go a little later
            if not any(k > last for k in shuffles()):
                break
            time.sleep(0.2)
        held.append({k for k in shuffles() if k > last})
        return compare(*a)

    monkeypatch.setattr(lines, "confirmed", watched)
    text = "a line that several documents hold with an edit "
    lines.dedup_lines(docs(spark, [(k, f"{text}{k % 9}\n{text}{k % 4} of its own {k % 5}") for k in range(60)])).collect()
    assert held == [set(), set()]


def test_a_large_bucket_is_dealt_over_tasks(spark):
    from marketloom.llm.common import Scratch

    rows = spark.range(400).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("component"), F.lit(None).cast("long").alias("own"), (F.col("id") % 40).cast("int").alias("part"))
    meet = lines.meetings(rows, Scratch(spark, "dealt"), "left", "node")
    pairs = Counter(tuple(sorted((a.node, b.node))) for r in meet.collect() for a in r.x for b in r.y)
    assert all(pairs[a, b] >= 1 for a in range(400) for b in range(a + 1, 400))
    assert "task" in meet._jdf.queryExecution().executedPlan().toString()


def test_mixing_against_a_literal_model(spark):
    from tokenizers import Tokenizer

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.mix(df, BPE, rounds=10, keep=["doc_id", "source", "lang"]).collect()
    t, n = Tokenizer.from_file(BPE), Counter()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in out:
        assert r.tokens == max(1, len(t.encode(texts[r.doc_id], add_special_tokens=False).ids))
        n[r.source, r.lang, r.topic] += r.tokens
    assert len({r.topic for r in out}) == 8 and len(out) == len(texts)
    x, all_ = {c: v * 0.5 for c, v in n.items()}, sum(n.values())
    for _ in range(10):
        for k, power in enumerate((0.7, 0.5, 0.5)):
            own = Counter()
            for c, v in n.items():
                own[c[k]] += v / all_
            goal = {v: w**power for v, w in own.items()}
            now = Counter()
            for c, v in x.items():
                now[c[k]] += v
            x = {c: v * all_ * 0.5 * goal[c[k]] / sum(goal.values()) / now[c[k]] if now[c[k]] else 0 for c, v in x.items()}
        x = {c: min(v, n[c]) for c, v in x.items()}
    for r in out:
        c = r.source, r.lang, r.topic
        assert r.probability == pytest.approx(x[c] / n[c], rel=1e-9)
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.selected == (u < r.probability)
    table = {r.doc_id: r.probability for r in mixing.mix(df, BPE, rounds=10, most_cells=0, keep=["doc_id"]).collect()}
    assert all(table[r.doc_id] == pytest.approx(r.probability, rel=1e-9) for r in out)


def test_mixing_meets_its_marginals(spark):
    rnd = random.Random(3)
    words = ["alpha beta gamma ", "uno dos tres ", "x1 y2 z3 ", "der die das "]
    rows = [(k, words[k % 4] * rnd.randint(5, 12)) for k in range(3000)]
    df = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 10 == 0, "rare").otherwise("common"))
    targets = {"source": {"rare": 0.15, "common": 0.85}}
    out = mixing.mix(df, BPE, share=0.4, targets=targets, topics=4)
    got = {(r.dimension, r.category): r for r in mixing.residuals(out, 0.4, targets).collect()}
    assert got["source", "rare"].target == pytest.approx(0.15)
    for r in got.values():
        assert r.expected == pytest.approx(r.target, abs=0.002) and r.drawn == pytest.approx(r.target, abs=0.03)
    by = defaultdict(set)
    for r in out.collect():
        by[r.doc_id % 4].add(r.topic)
    assert [len(v) for v in by.values()] == [1] * 4 and len(set.union(*by.values())) == 4


def test_topics_are_fitted_on_all_documents(spark):
    # The rare kind is last in the order by which 2,000 documents were sampled before.
    order = spark.range(6000).select("id", F.xxhash64("id", F.lit("topics")).alias("h")).orderBy("h").collect()
    rare = {r.id for r in order[-3:]}
    df = docs(spark, [(k, ("zebra quartz " if k in rare else "alpha beta gamma " if k % 2 else "der die das ") * 6) for k in range(6000)])
    got = {r.doc_id: r.topic for r in mixing.mix(df, BPE, topics=3, keep=["doc_id"]).select("doc_id", "topic").collect()}
    by = [{got[k] for k in got if k in rare}, {got[k] for k in got if k not in rare and k % 2}, {got[k] for k in got if k not in rare and not k % 2}]
    assert [len(v) for v in by] == [1, 1, 1] and len(set.union(*by)) == 3


def test_hashed_counts_are_whole():
    ids = np.repeat(np.arange(6, dtype="<u4"), [1, 254, 255, 256, 70_000, 300_000])
    for x in (ids, ids[:0], ids[:200]):
        counts = np.bincount((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(int), minlength=mixing.WIDTH)
        logs = np.log1p(counts.astype(float))
        got = mixing.profiles([mixing.hashed_counts(ids[:9]), mixing.hashed_counts(x), mixing.hashed_counts(ids)])
        assert got[1] == pytest.approx(logs / max(np.sqrt((logs * logs).sum()), 1e-12), abs=1e-15)


def test_all_passes_of_the_fit_cost_less_than_the_tokens():
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    b = bpe(BPE)
    began = time.thread_time()
    counts = [mixing.hashed_counts(np.frombuffer(b.packed(x), "<u4")) for x in texts]
    tokens, batch = time.thread_time() - began, pa.record_batch([pa.array(counts, pa.binary())], ["counts"])
    mean = mixing.profiles(counts).mean(0)
    centres = mixing.apart(mixing.profiles(counts[:8]), mean)
    began = time.thread_time()
    for _ in range(7):
        list(mixing._farthest([batch], mean, centres))
    for _ in range(20):
        list(mixing._sums([batch], mean, centres))
    assert time.thread_time() - began < tokens


def test_mixing_odd_rows(spark):
    clash = ["cell", "cell_source", "cell_lang", "cell_topic", "row", "topic", "tokens", "selected", "probability", "profile", "of"]
    odd = docs(spark, [(None, None), (1, ""), (1, ""), (2, "word " * 300_000)]).withColumn("lang", F.lit(None).cast("string"))
    odd = odd.withColumns({c: F.lit(k) for k, c in enumerate(clash)})
    got = mixing.mix(odd, BPE).collect()
    assert sorted(r.tokens for r in got)[:3] == [1, 1, 1] and len(got) == 4 and mixing.mix(odd.where("false"), BPE).count() == 0
    assert [r.tokens for r in got if r.doc_id == 2][0] >= 300_000
    for kept in (mixing.keep_mixed(odd, BPE, share=1.0), mixing.keep_mixed(odd, BPE, share=1.0, most_cells=0)):
        assert kept.columns == odd.columns
        assert {(r.cell_source, r.topic, r.probability) for r in kept.collect()} <= {(1, 5, 8)}
    assert mixing.keep_mixed(odd.where("doc_id IS NULL"), BPE).count() in (0, 1)


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, b, rnd = Tokenizer.from_file(BPE), bpe(BPE), random.Random(0)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "23", "!", "<|endoftext|>", "<|", "\x1c", "\u0085", "🙂", " ", "\r", "中", "word", " the"]
    for _ in range(3000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert t.encode(s, add_special_tokens=False).ids == np.frombuffer(b.packed(s), "<u4").tolist()


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rnd, t = random.Random(0), Tokenizer.from_file(BPE)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "x1"]) for _ in range(rnd.choice([0, 5, 300, 900, 5000])))) for k in range(120)] + [(500, None), (501, "<|endoftext|> a"), (500, None)]
    out = packing.best_fit_packing(docs(spark, rows).withColumn("length", F.lit("clash")), BPE, shard_pieces=40).collect()
    pieces, room = defaultdict(list), 2048
    for r in out:
        pieces[r.doc_id].append(r)
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[i], key=lambda r: r.piece)[:: 2 if i == 500 else 1]
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1].tolist()] and sum(r.length for r in got) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got) and all(r.length == room for r in got[1:])
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= room
    assert len(bins) <= -(-sum(r.length for r in out) // room) + 5
    assert packing.best_fit_packing(docs(spark, []).where("false"), BPE).count() == 0


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    for items in ([6], [6], [4], [3, 1], [5], [5]):
        b = bins.add()
        for k, n in enumerate(items):
            bins.put(b, (n, 10 * b + k))
    packing.local_search(bins, 1000, 8)
    assert sum(bool(x) for x in bins.items) == 3
    for lengths in ([7, 6, 5, 4, 3, 3, 2], [9, 8, 2, 1], [1] * 25, []):
        at = packing.pack(lengths, 10)
        fill = Counter()
        for (b, _), n in zip(at, lengths):
            fill[b] += n
        assert all(v <= 10 for v in fill.values()) and len(fill) == -(-sum(lengths) // 10)


def test_swaps_raise_the_sum_of_squares():
    rnd = random.Random(7)
    for _ in range(50):
        bins = packing.Bins(100)
        for b in range(8):
            bins.add()
            while bins.free[b] > 20 and rnd.random() < 0.9:
                bins.put(b, (rnd.randint(1, min(60, bins.free[b])), rnd.random()))
        square = lambda: sum((100 - f) ** 2 for f in bins.free)
        for _ in range(50):
            if len(bins.open) < 2:
                break
            before, source = square(), bins.open[-1][1]
            if not packing.exchange(bins, source, [b for _, b in bins.open]):
                break
            assert square() > before and min(bins.free) >= 0


def test_rollups_are_idempotent_and_additive(spark, tmp_path):
    ledger = rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    feed = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None, None, None), ("insert", "a", None, "v1", None, None, None, None), ("insert", "b", "en", "v1", 5, None, None, None)], feed)
    two = spark.createDataFrame([("revise", "b", "en", "v1", 7, "a", "en", 10), ("delete", "b", "en", "v1", 5, None, None, None)], feed)
    totals = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in ledger.totals().collect()}
    assert totals() == {}
    assert ledger.commit("one", rollups.signed(one)) and not ledger.commit("one", rollups.signed(one))
    assert totals() == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 0), ("b", "en", "v1"): (1, 5)}
    assert ledger.commit("two", rollups.signed(two))
    want = {("a", None, "v1"): (1, 0), ("b", "en", "v1"): (1, 7)}
    assert totals() == want
    ledger.fold()
    assert totals() == want and not ledger.commit("two", rollups.signed(two))
    assert ledger.commit("none", rollups.signed(one.where("false"))) and totals() == want
    ledger.fold()
    assert totals() == want
    with pytest.raises(Exception, match="unknown change"):
        ledger.commit("bad", rollups.signed(one.withColumn("op", F.lit("?"))))


def test_a_batch_that_comes_during_a_fold_counts_once(spark, tmp_path):
    ledger = rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    row = spark.createDataFrame([("a", "en", "v", 1, 10)], rollups.SCHEMA)
    assert ledger.commit("one", row)
    sums = ledger._sums

    def late(*args):
        assert ledger.commit("two", row)
        return sums(*args)

    ledger._sums = late
    ledger.fold()
    ledger._sums = sums
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 2, 20)]
    staged = f"{ledger.root}/staged/late"
    row.write.parquet(staged)
    assert not ledger._place(staged, f"{ledger.root}/batches/two")
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 2, 20)]


def test_corpus_rollup_keeps_one_of_each_text(spark):
    rows = docs(spark, [(None, "only null ids"), (None, "only null ids"), (3, "twice"), (3, "twice"), (4, "twice"), (5, None), (6, "")]).withColumn("digest", F.lit("clash"))
    got = {(r.version): 0 for r in rollups.corpus_rollup(rows, BPE, "v").collect()}
    for r in rollups.corpus_rollup(rows, BPE, "v").collect():
        got[r.version] += r.docs
    assert got == {"v": 3, "words-1": 3}


def test_corpus_rollup_equals_a_recount(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want, seen = Counter(), set()
    for r in table.orderBy("doc_id").collect():
        if (r.text or "") not in seen:
            seen.add(r.text or "")
            for v, n in (("v", len(t.encode(r.text or "", add_special_tokens=False).ids)), ("words-1", len((r.text or "").split()))):
                want[r.source, r.lang, v, "docs"] += 1
                want[r.source, r.lang, v, "tokens"] += n
    got = {}
    for r in rollups.corpus_rollup(table, BPE, "v").collect():
        got |= {(r.source, r.lang, r.version, "docs"): r.docs, (r.source, r.lang, r.version, "tokens"): r.tokens}
    assert got == {k: v for k, v in want.items()}
