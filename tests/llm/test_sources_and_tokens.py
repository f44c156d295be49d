import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeloom.llm import _common as C
from codeloom.llm import mixing, packing, token_blocks, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "one", "one two\nthree  four", "x" * 30_000, "É ΣΑΣ 日本 語. a,b's <|endoftext|>", "a b " * 4000, "same words here", "same words here", "\t\n"]
KINDS = "doc_id long, text string, source string, size string, hash string, part string"


def rows():
    rng = random.Random(3)
    out = [(i, t, "ab"[i % 2] if i != 3 else None, "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    out += [(100 + i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(1, 90))), rng.choice(["a", "a", "b", "c", None]), "s", "h", "p") for i in range(300)]
    return out + [(None, "no id", "a", None, None, None), (2, "tie", "b", None, None, None), (100, *out[11][1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KINDS).repartition(3)


def test_fit_is_exact_where_a_sum_exists():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 5) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randrange(1, max(sums) + 1)
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        total = sum(a * b for a, b in zip(lengths, took))
        base = sum(n * (c * budget // sum(a * b for a, b in zip(lengths, counts))) for n, c in zip(lengths, counts))
        free = {base}
        for n, c in zip(lengths, counts):
            had = c * budget // sum(a * b for a, b in zip(lengths, counts))
            free = {s + k * n for s in free for k in range(c - had + 1)}
        assert abs(total - budget) == min(abs(s - budget) for s in free)


def test_targets_share_the_excess():
    t = mixing.targets([("a", 10), ("b", 1000), (None, 10), ("c", 1)])
    assert t["a"] == 20 and t["c"] == 2 and t[None] == 20
    assert sum(t.values()) == mixing.SHARE * 1021


def test_mix(spark, docs):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    given = Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in rows())
    assert Counter((r.doc_id, r.size) for r in out) == given
    by = defaultdict(list)
    for r in out:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    want = mixing.targets([(s, sum(r.size for r in x)) for s, x in by.items()])
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target == float(want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= max(3, 0.01 * x[0].source_size)
    assert mixing.mix(docs.limit(0)).count() == 0


def pages():
    long = "p" * 100
    return [(1, "http://a/é x", long), (2, None, long), (5, "u", long), (3, "u", "p" * 99), (4, "u", "p" * 99), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n é" * 9000), (None, "u", long), (2, "u", long), (1, "u", long)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    out = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(df).collect()]
    want = [(i, *(("revisit", 1) if len(h or "") == 100 and i != 1 else ("response", None)), len((h or "").encode())) for i, _, h in pages()]
    assert Counter(out) == Counter(want)
    assert warc.archive(df.limit(0)).count() == 0


def test_one_record_by_the_index(tmp_path):
    import hashlib

    path = str(tmp_path / "b")
    bundle = warc.Bundle(pa.OSFile(path, "wb"), frame_bytes=500)
    bodies = {str(i): b"body %d " % i * i for i in range(60)}
    for k, b in bodies.items():
        bundle.add(k, warc.record("response", int(k), None, b, len(b), hashlib.sha256(b).hexdigest(), None))
    bundle.close()
    file = warc.BundleFile(pa.OSFile(path, "rb"))
    assert len(bundle.frames) > 5
    for k, b in bodies.items():
        assert file.read(k)[1] == b
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == b"".join(file.frames())


@pytest.mark.parametrize("kind", ["random", "equal", "outliers", "wide"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(2)
    ids = {"random": rng.integers(0, 50_000, 5 * 512), "equal": np.full(512, 7), "outliers": np.where(rng.random(2048) < 0.05, 2**32 - 1, 3), "wide": rng.integers(0, 2**32, 1024)}[kind].astype(np.uint32)
    raw = token_blocks.pack_blocks(ids)
    starts = np.cumsum([0, *map(len, raw[:-1])])
    assert (token_blocks.unpack_blocks(b"".join(raw), starts) == ids).all()


def brute_ids(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r[0], r[1] or "", np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")) for r in rows()]


def test_token_files(spark, docs):
    out = token_blocks.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = brute_ids("byte_bpe_50k.json", 0)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, _, x in want)
    out.sort(key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -1 for r in out]
    assert ids == sorted(ids)
    assert token_blocks.token_files(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_reader_reads_any_range(spark, docs):
    folder = C.shared_folder(spark, "t")
    manifest = token_blocks.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    path = manifest.orderBy("n_ids").collect()[-1].path
    with C.read_shared(path) as f:
        reader = token_blocks.BlockReader(f)
        whole = reader.ids(0, reader.total)
        for a, b in [(0, 1), (511, 513), (600, 600), (reader.total - 3, reader.total)]:
            assert (reader.ids(a, b) == whole[a:b]).all()


def test_tightest_window():
    tree = packing.CapacityTree(2048)
    for w, room in enumerate([100, 2048, 5, 100, 64]):
        tree.put(w, room)
    assert tree.take(65) == (3, 100) and tree.take(65) == (0, 100) and tree.take(65) == (1, 2048) and tree.take(65) is None
    assert tree.take(5) == (2, 5) and tree.take(1) == (4, 64)


def test_packing(spark, docs):
    name = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs, name, shard_pieces=100).collect()
    want = brute_ids("word_bpe_49k.json", 1)
    pieces = Counter((i, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes()), len(x)) for i, _, x in want for at in range(0, len(x), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == pieces
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for x in by.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == [sum(y.length for y in x[:i]) for i in range(len(x))]
        assert sum(r.length for r in x) <= 2048
    again = packing.pack_documents(docs.repartition(7), name, shard_pieces=100).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert packing.pack_documents(docs.limit(0), name).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.assign_windows(pieces, shard_pieces=100)
    total = 0
    for r in packing.sequences(packed, pad_id=9).collect():
        n = len(r.ids) // 4
        assert n == 2048 or n & (n - 1) == 0
        total += (np.frombuffer(r.ids, "<u4") == 1).sum()
    assert total == len(rows())


def test_repeated_pieces_spread_over_shards(spark):
    rows = [(None, 0, 1, 7, 1)] * 5000 + [(i, 0, 900, i, 901) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = packing.assign_windows(df, shard_pieces=500).collect()
    assert Counter(r[:5] for r in map(tuple, out)) == Counter(rows)
    shards = Counter(r.sequence_id % 11 for r in out)
    assert len(shards) == 11 and max(shards.values()) < 1000
    again = packing.assign_windows(df.repartition(9), shard_pieces=500).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_written_sequences(spark, docs, tmp_path):
    name = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.write_sequences(docs, name, f"{tmp_path}/seq", pad_id=9, shard_pieces=100).collect()
    held = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in spark.read.parquet(f"{tmp_path}/seq").collect()}
    assert set(held) == {r.sequence_id for r in packed}
    used = defaultdict(int)
    for r in packed:
        assert zlib.crc32(held[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32
        used[r.sequence_id] += r.length
    for s, ids in held.items():
        assert len(ids) == (used[s] if used[s] & (used[s] - 1) == 0 else 2048) and (ids[used[s] :] == 9).all()
    assert Counter(map(tuple, packed)) == Counter(map(tuple, packing.pack_documents(docs, name, shard_pieces=100).collect()))


def test_token_files_of_bounded_size(spark, docs):
    name = public_tokenizers.path("byte_bpe_50k.json")
    whole = Counter(map(tuple, token_blocks.token_files(docs, name).collect()))
    manifest = token_blocks.write_token_files(docs, name, C.shared_folder(spark, "t"), file_ids=300).collect()
    assert len(manifest) > 20 and all(m.n_ids < 300 + 20_000 for m in manifest)
    assert Counter(map(tuple, token_blocks.token_files(docs, name, file_ids=300).collect())) == whole


def test_warc_headers_and_identifiers(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    manifest = warc.write_bundles(df, C.shared_folder(spark, "w"), date="2024-05-06T07:08:09Z").collect()
    seen, found = Counter(), []
    for m in manifest:
        with C.read_shared(m.path) as f:
            file = warc.BundleFile(f)
            for key in file.index():
                head, payload = file.read(key)
                seen[key] += 1
                assert head["WARC-Record-ID"] == f"<{key}>" and head["WARC-Date"] == "2024-05-06T07:08:09Z" and head["Content-Type"].startswith("application/http")
                found.append((head["X-Page-ID"], payload if head["WARC-Type"] == "response" else None))
            raw = file.frame(0)
            at = raw.index(b"\r\n\r\n") + 4
            assert raw[:at].decode().startswith("WARC/1.1") and (b"WARC-Type: revisit" in raw[:at] or raw[at:].startswith(b"HTTP/1.1 200 OK"))
    assert max(seen.values()) == 1 and sum(seen.values()) == len(pages())
    assert Counter(i for i, _ in found) == Counter("null" if i is None else str(i) for i, *_ in pages())


def test_an_index_that_lies_is_found(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle = warc.Bundle(pa.OSFile(path, "wb"), frame_bytes=10_000)
    for i in range(5):
        bundle.add(f"urn:{i}", warc.record("response", i, None, b"x" * i, i, "d", None, f"urn:{i}"))
    bundle.index[2] = bundle.index[2].replace(b"urn:2", b"urn:1")
    bundle.close()
    with pytest.raises(ValueError, match="place|lacks"):
        list(warc.BundleFile(pa.OSFile(path, "rb")).records())
