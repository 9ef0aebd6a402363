"""Archives, vectors, media and chats: round trips and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, chat, ogg, queries, warc
from marketloom.llm.common import Scratch
from marketloom.llm.tokens import public_path

BPE = public_path("byte_bpe_50k.json")


def test_archives_round_trip(spark):
    rnd = random.Random(0)
    body = ["é" * 60, "y" * 99, "z" * 100, None, "", "w" * 5000]
    rows = [(k, f"http://www.Host{k % 3}.Example.com:80/p?q={k % 5}#f", body[k % 6] if k % 2 else f"<p>{rnd.random()}</p>" * 9) for k in range(200)]
    rows += [(300, None, "z" * 100), (301, "a\tb\nc", "z" * 100), (7, rows[7][1], rows[7][2]), (None, "http://x.org", "w" * 5000)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(1))
    for r in warc.archive(df).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        for r in got[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            least = first.get(raw, page)
            assert (r.record_type, r.refers_to) == (("response", None) if least == page else ("revisit", least))
    assert warc.archive(df.where("false")).count() == 0


def test_index_orders_keys_as_they_are_stored(spark):
    names = ["a", "a\tb", "a!", "a%", "a\nb", "a0", "a%09", "a\t"]
    df = spark.createDataFrame([(x, k, "f", 10 * k, 5) for k, x in enumerate(names)], warc.LINE)
    index = warc.CaptureIndex.build(df, Scratch(spark, "cdx"), block_lines=2, shards=3)
    assert all(index.find(x, k) == [("f", 10 * k, 5)] for k, x in enumerate(names))
    got = warc.look_up(df, index, must=True).collect()
    assert sorted(r.offset for r in got) == [10 * k for k in range(len(names))]
    with pytest.raises(Exception, match="no capture"):
        warc.look_up(df.withColumn("surt", F.lit("b")), index, must=True).collect()


def test_index_finds_by_binary_search(spark):
    keys = [(f"com,h{k % 4})/{k // 3:03d}", k, "f", 10 * k, 5) for k in range(500)] + [("com,h0)/000", 0, "g", 1, 2)]
    scratch = Scratch(spark, "cdx")
    index = warc.CaptureIndex.build(spark.createDataFrame(keys, warc.LINE).repartition(3), scratch, block_lines=7, shards=5)
    assert len(index.shards) > 1
    for k in range(500):
        assert (keys[k][2], 10 * k, 5) in index.find(keys[k][0], k)
    assert sorted(index.find("com,h0)/000", 0)) == [("f", 0, 5), ("g", 1, 2)]
    assert index.find("com,h0)/000", 99_999) == [] and index.find("zzz", 1) == [] and index.find("", None) == []
    assert len(index.blocks) <= index.keep


def test_surt(spark):
    urls = {"http://www.A.b.com:80/x?y=1#z": "com,b,a)/x?y=1", "https://user@h.org": "org,h)/", "": "", "h.org?q": "org,h)/?q", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.surt().alias("s")).collect()
    assert {r.url: r.s for r in rows} == urls


def exact(vectors, queries_, k):
    out = {}
    for q, x in queries_:
        scores = sorted(((-float(np.dot(np.float64(x), np.float64(y))), v) for v, y in vectors if v != q and len(y) == len(x)))
        out[q] = scores[:k]
    return out


def test_search_recall_on_vectors_without_clusters(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    want = exact(list(enumerate(x)), [(q, x[q]) for q in range(0, 6000, 100)], 20)
    hits = sum(len({r.vec_id for r in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[q].astype(float) @ x[r.vec_id].astype(float)), abs=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def test_search_of_all_buckets_is_exact_on_odd_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, rnd.normal(size=5).tolist()) for k in range(60)] + [(k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(100, 160)]
    rows += [(k, rnd.normal(size=3).tolist()) for k in range(200, 210)]
    bad = [(300, None), (301, [0.0] * 5), (302, [float("nan")] * 5), (303, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (304, []), (None, [1.0] * 5), (305, [None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("bucket", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, k=20, probes=1 << 30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(rows, rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for _, v in want[q]] or np.allclose([s for _, s in got[q]], [-s for s, _ in want[q]], atol=1e-12)
        assert len(got[q]) == len(want[q])
    assert [v for v, _ in got[100]][:3] == [101, 102, 103]
    assert ann.nearest(df.where("false")).count() == 0


def test_repeated_rows_take_no_ones_place(spark):
    rows = [(1, [1.0, 2.0])] * 30 + [(k, [1.0, 2.0]) for k in range(2, 12)] + [(1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df, k=20).collect()}
    want = {(q, rank): v for q in range(1, 12) for rank, v in enumerate([v for v in range(1, 12) if v != q], 1)}
    assert got == want


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding)) for r in df.collect()]
    want = exact(rows, [(q, x) for q, x in rows if q % 20 == 0], 20)
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_pairs_of_axes(spark):
    rnd = np.random.default_rng(8)
    x = np.repeat(rnd.normal(size=(60, 16)), 50, 0) + 0.1 * rnd.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 30 = 0"), hashes=2).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(list(enumerate(x)), [(q, x[q]) for q in range(0, 3000, 30)], 20)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_lengths_count_for_the_inner_product(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(4000, 16)) * rnd.uniform(0.5, 2, (4000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 80 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(list(enumerate(x)), [(q, x[q]) for q in range(0, 4000, 80)], 20)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("norms", ["one", "uniform", "log-normal"])
def test_recall_with_uneven_norms_at_full_width(spark, norms):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "one":
        x[-1] *= 3
    else:
        x *= (rnd.uniform(0.5, 1.5, 3000) if norms == "uniform" else np.exp(0.3 * rnd.normal(size=3000)))[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 15 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(list(enumerate(x)), [(q, x[q]) for q in range(0, 3000, 15)], 20)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_hadamard_is_orthonormal():
    m = ann.hadamard(np.eye(16))
    assert np.allclose(m @ m.T, np.eye(16)) and np.allclose(ann.hadamard(m), np.eye(16))


def bitwise(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksums():
    for n in (0, 1, 7, 300):
        data = bytes(random.Random(n).randbytes(n))
        assert ogg.checksum(data) == bitwise(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 510, 65_025, 65_024, 70_000, 200_000])
def test_packets_of_any_length(n):
    packet = random.Random(n).randbytes(n)
    streams = {5: [(b"head", 0), (packet, n), (b"", n), (packet[:100], n + 1)], 9: [(b"x", 0), (b"y" * 300, 7)]}
    assert {s: [p for p, _ in v] for s, v in ogg.demultiplex(ogg.multiplex(streams)).items()} == {s: [p for p, _ in v] for s, v in streams.items()}
    assert ogg.demultiplex(ogg.multiplex(streams))[5][-1][1] == n + 1


def test_damage_is_seen():
    media = ogg.store(b"abc" * 30_000)
    assert ogg.load(media)[0] == b"abc" * 30_000
    for at in (5, 27, 40, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.load(bytes(broken))
    for cut in (10, len(media) // 2, len(media) - 3):
        with pytest.raises(ValueError):
            ogg.load(media[:cut])


def test_media_columns(spark):
    texts = [None, "", "é", "x" * 64, "y" * 63, "z" * 200_000, "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in ogg.read_ogg(ogg.to_ogg(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.store(full)).hexdigest() and r.media_bytes == len(ogg.store(full))
    assert got[3][1:] == got[6][1:] and "seconds=0.008000" in got[3].feature
    assert ogg.read_ogg(ogg.to_ogg(df.where("false"))).count() == 0


def test_escaping_is_reversible():
    rnd = random.Random(0)
    for _ in range(5000):
        s = "".join(rnd.choice(["<", "|", "\\", "\n", "a", chat.START, chat.END, "<|endoftext|>"]) for _ in range(rnd.randint(0, 8)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        role = chat.escape_role(s)
        assert chat.unescape_role(role) == s and "\n" not in role and "<|" not in role


def test_chats_read_back(spark):
    rnd, rows = random.Random(1), []
    for conv in [*range(20), None]:
        for turn in range(rnd.randint(1, 9)):
            text = rnd.choice([None, "", "hi there", chat.START + "x" + chat.END, "é\n\n🙂", "<\\|im_end|>", "<|endoftext|>", "long " * 4000])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "odd\nrole\\", None]), text))
    rows += [(3, None, "user", "first"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(df, BPE), BPE).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role is not None, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        r = got[conv]
        whole = "".join(f"{t[2]}\n{t[4]}\n" for t in turns)
        loss = "".join(t[4] for t in turns if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.START) + len(chat.escape_role(t[2])) + 1 + len(chat.escape(t[4])) + len(chat.END) + 1 for t in turns)
    assert chat.read_back(chat.assemble(df.where("false"), BPE), BPE).count() == 0


def test_masks_are_prefix_sums(spark):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(6)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.assemble(df, BPE).collect(), key=lambda r: r.turn_no)
    at = 0
    for r in rows:
        assert r.start == at and (r.mask_end > r.mask_start) == (r.turn_no % 2 == 1)
        at += len(r.ids) // 4


def test_queries_run_on_the_smallest_tables(spark, sf):
    counts = {"op1_warc_index": "pages", "op3_ogg_media": "documents", "op10_best_fit_packing": None, "op6_chat_format": None}
    for name, table in counts.items():
        n = queries.queries()[name](spark, sf).count()
        assert n > 0 and (table is None or n == spark.read.parquet(f"{sf}/{table}.parquet").count())
