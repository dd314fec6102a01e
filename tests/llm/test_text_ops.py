"""License scan, media columns, byte-level BPE, packing: against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import _common as C
from ledgerloom.llm import byte_bpe, license_scan, media_columns, packing

TEXTS = [None, "", " ", "\n", "a", "Licensed under CC BY-NC 4.0.", "x" * 3000, "All rights reserved. all RIGHTS reserved", "CC BY cc by", "日本語 テキスト é ß", "it's  a\t\ttest \n\n end ", "1234 5678!! ***", "<|endoftext|>", "a b" * 400, "Released under the MIT License."]
CLASH = "doc_id long, text string, lang string, n_words string, ids string, row_key string, node string, kept_text string"


def docs(spark, texts, ids=None):
    """Rows with clashing extra columns; the ids repeat where asked."""
    rows = [(k if ids is None else ids[k], t, None, "x", "y", "z", "n", "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


# -- license scan


@pytest.mark.parametrize(
    "text,base,labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-family"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gnu-gpl,gpl"),
        ("Licensed under the Apache License, Version 2.0.", "", "apache-2.0"),
        ("Licensed under the Apache License 2.0", "", "apache-2.0"),
        ("Licensed under an Apache License 2.0", "", ""),
        ("Released under the MIT License.", "", "mit"),
        ("Copyright (c) 2020 Some Body. All rights reserved.", "reserved", "copyright-notice,reserved"),
        ("all rights are reserved", "", ""),
        ("general public  LICENSE", "gpl", "gpl"),
    ],
)
def test_labels(spark, text, base, labels):
    r = license_scan.scan_licenses(docs(spark, [text])).first()
    assert (r["base_labels"], r["labels"]) == (base, labels)
    assert r["score"] == 1 - 0.5 ** len([x for x in labels.split(",") if x])


def test_scan_counts(spark):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, TEXTS)).collect()}
    for k, t in enumerate(TEXTS):
        words = license_scan.WORD.findall((t or "").encode().lower())
        assert got[k]["n_words"] == len(words)
        places = [i for phrase in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        assert got[k]["n_base"] == len(places) and got[k]["first_word"] == min(places, default=None) and got[k]["last_word"] == max(places, default=None)


def test_bad_templates():
    for markup in ("<<beginOptional>>a", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<odd>> a"):
        with pytest.raises(ValueError):
            license_scan.parse_template("x", markup)


# -- media columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_payload_round_trip(parts):
    payloads = [p + bytes(-len(p) % 64 or 64 * (not p)) for p in parts]
    frames, back, thumbs = media_columns.read_payloads(media_columns.store_payloads(payloads))
    assert back == payloads
    for f, t in zip(frames, thumbs):
        assert t.shape == (f.height // 8, f.width // 8)


def test_store_texts(spark):
    rows = media_columns.store_texts(docs(spark, TEXTS)).collect()
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert media_columns.read_payloads([r["media"]])[1] == [payload]
    assert len({r["feature"] for r in rows if not TEXTS[r["doc_id"]]}) == 1


def _encode(width, height, sampling, blocks, restart):
    """A scalar baseline encoder: blocks in scan order, {component: [coefficients]}; codes of 8 bits, one for each symbol."""
    symbols = sorted({0x00, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})[:200]
    dc = list(range(12))
    bits, out, before = "", b"", [0] * len(sampling)

    def size(v):
        return abs(v).bit_length()

    def value(v):
        s = size(v)
        return format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        body = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
        out += body.replace(b"\xff", b"\xff\x00")
        bits = ""

    mcus = len(blocks)
    for m, mcu in enumerate(blocks):
        if restart and m and m % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            before = [0] * len(sampling)
        for c, block in mcu:
            diff = block[0] - before[c]
            before[c] = block[0]
            bits += format(dc.index(size(diff)), "08b") + value(diff)
            run = 0
            for v in block[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += format(symbols.index(0xF0), "08b")
                    run -= 16
                bits += format(symbols.index(run << 4 | size(v)), "08b") + value(v)
                run = 0
            if run:
                bits += format(symbols.index(0), "08b")
    flush()
    assert mcus
    chunk = media_columns._chunk
    table = lambda kind, syms: chunk(0xC4, bytes([kind]) + bytes([0] * 7 + [len(syms)] + [0] * 8) + bytes(syms))
    frame = chunk(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    scan = chunk(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + bytes([0, 63, 0]))
    return b"\xff\xd8" + chunk(0xDB, bytes([0] + [2] * 64)) + frame + table(0, dc) + table(0x10, symbols) + (chunk(0xDD, bytes([0, restart])) if restart else b"") + scan + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)]])
def test_general_images(spark, sampling, restart):
    """Colour with subsampling, runs, end-of-block codes: coefficients and thumbnails as they were put in."""
    rng = np.random.default_rng(5)
    width, height = 40, 24
    h, v = sampling[0] if len(sampling) > 1 else (1, 1)
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    rows = []
    for _ in range(wide * high):
        mcu = []
        for c, (ch, cv) in enumerate(sampling):
            for _ in range(ch * cv):
                block = np.where(rng.random(64) < 0.9, 0, rng.integers(-500, 500, 64))
                block[0] = rng.integers(-400, 400)
                mcu.append((c, block.tolist()))
        rows.append(mcu)
    data = _encode(width, height, sampling, rows, restart)
    f = media_columns.parse_markers(data)
    got = media_columns.decode_coefficients([data, data], [f, f])[1]
    grid = np.zeros((high * v, wide * h, 64), int)
    for m, mcu in enumerate(rows):
        mine = [b for c, b in mcu if c == 0]
        for k, b in enumerate(mine):
            grid[m // wide * v + k // h, m % wide * h + k % h] = b
    assert (got[0] == grid).all()
    r = media_columns.jpeg_thumbnails(spark.createDataFrame([(1, data), (2, data[: len(data) // 2]), (3, None), (4, b"")], "media_id long, data binary")).orderBy("media_id").collect()
    assert (r[0]["width"], r[0]["height"], r[0]["thumb_width"], r[0]["thumb_height"]) == (40, 24, 5, 3)
    want = np.clip((grid[:3, :5, 0] * 2 + 4) // 8 + 128, 0, 255)
    assert list(r[0]["thumb"]) == want.ravel().tolist() and len(r[0]["thumb_hash"]) == 16
    assert all(x["width"] is None and x["error"] for x in r[1:])


# -- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    bpe = byte_bpe.ByteBPE.from_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return bpe, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocab, special_tokens={})


ODD = st.text(alphabet="ab \n\t'sté漢1 9.!-\r<|endoftext|>XYñ ́  ", max_size=80)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_bpe_like_the_library(library, text):
    bpe, enc = library
    got = C.ChunkCache(bpe.encode_chunks).ids([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(text) and bpe.decode(got) == text.encode()


def test_long_pieces(library):
    bpe, enc = library
    for text in ("a" * 5000, "ab" * 3000 + "x" * 700, "é" * 1000, " " * 3000 + "x", "=" * 999):
        assert np.frombuffer(C.ChunkCache(bpe.encode_chunks).ids([text])[0], "<u4").tolist() == enc.encode_ordinary(text)


def test_cache_generations(library):
    bpe, enc = library
    cache = C.ChunkCache(bpe.encode_chunks, limit=20)
    for k in range(30):
        text = " ".join(f"w{(k * j) % 37}" for j in range(30))
        assert np.frombuffer(cache.ids([text])[0], "<u4").tolist() == enc.encode_ordinary(text)


def test_encode_documents(spark, library):
    import public_tokenizers as P

    _, enc = library
    path = P.path("byte_bpe_50k.tiktoken")
    for r in byte_bpe.encode_documents(docs(spark, TEXTS, [1] * len(TEXTS)), path, P.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(r["decoded"].decode()) and r["n_tokens"] == len(r["ids"]) // 4
    assert byte_bpe.encode_documents(docs(spark, TEXTS).limit(0), path, P.PATTERN, digests=True).count() == 0


# -- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_everything(histogram):
    plan = packing.plan_bins(histogram, 64, rounds=20)
    held: dict = {}
    for times, items in plan:
        assert times > 0 and sum(length * n for length, n in items) <= 64
        for length, n in items:
            held[length] = held.get(length, 0) + n * times
    assert held == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert least <= sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(histogram, 64)) * 1.1 + 1


def test_pricing_is_best():
    rng = np.random.default_rng(1)
    lengths, weight = np.array([3, 5, 7, 11]), rng.random(4)
    got = packing.price(lengths, weight, 20)
    best = max((a * weight[0] + b * weight[1] + c * weight[2] + d * weight[3]) for a in range(7) for b in range(5) for c in range(3) for d in range(2) if 3 * a + 5 * b + 7 * c + 11 * d <= 20)
    assert abs(sum(weight[k] * n for k, n in got.items()) - best) < 1e-9


def test_pack_documents(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = TEXTS * 3
    rows = packing.pack_documents(docs(spark, texts), P.path("byte_bpe_50k.json"), capacity=64, keep_ids=True).collect()
    places: dict = {}
    for k, t in enumerate(texts):
        want = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [i for r in mine for i in np.frombuffer(r["ids"], "<u4").tolist()] == want
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
        assert all(r["length"] == 64 for r in mine[1:]) and all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in mine)
        assert len(mine) == -(-len(want) // 64)
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack_documents(docs(spark, texts).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_added_tokens_like_the_library(spark, tmp_path):
    """The query against the library at its default settings, and the path for what the compiled one gives up on."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftex", "plain"]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.op6_packing(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(texts))] == [zlib.crc32(np.array([*w, 0], "<u4").tobytes()) for w in want]
    slow = packing._Tokenizer(P.path("byte_bpe_50k.json"), True)
    assert [np.frombuffer(slow._slow(t), "<u4").tolist() for t in texts] == want
