"""Exact round trips: token store, GIF, pieces."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import gif, pieces, token_store


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=400))
def test_pack_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, escapes = token_store.pack(x)
    assert (token_store.unpack(words, escapes, len(x)) == x).all()
    lengths, back = token_store.from_block(token_store.to_block(np.array([len(x)]), x))
    assert lengths.tolist() == [len(x)] and (back == x).all()


def test_pack_is_dense():
    words, _ = token_store.pack(np.zeros(240, np.uint64))
    assert len(words) == 2
    words, _ = token_store.pack(np.full(30, 3, np.uint64))
    assert len(words) == 1


def _library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["<|endoftext|> a<|startoftext|>b", "İstanbul ẞ ǅ", "á é x y\x1cz", "don't 'S it's I'M, they'll", "\x0b\x0cx\x85y", "ΑΣ ΟΔΥΣΣΕΥΣ", " ́ x́ ń", "\x01 a\x01b \x01\x01", "", "   ", "a.b. c,. D, E.. F., G!! h*** i'", "ﬁ ª º", "Ǆ ŉ ſ", "ö̈, Ö."]


def test_words_encode_as_texts_do():
    from readloom.llm.common import buffers
    import pyarrow as pa

    rng = random.Random(0)
    texts = ODD + ["".join(rng.choices("aAbéÉ'.,!1 \n\tΣ漢́", k=rng.randint(0, 60))) for _ in range(300)]
    encode = token_store.word_bpe()
    for _ in range(2):
        ids, counts = encode(*buffers(pa.array(texts)))
        cut = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == _library(texts)


def test_token_store(spark, awkward, nothing, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_ids(awkward, path, token_store.word_bpe())
    rows = token_store.read_documents(spark, path).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    start = 0
    texts = {}
    for d, t in want:
        texts.setdefault(d, []).append(_library([t])[0] + [1])
    for r in rows:
        assert r.start == start and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    token_store.write_ids(nothing, str(tmp_path / "none"), token_store.word_bpe())
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 9), st.sampled_from([1, 3, 1024]))
def test_gif_round_trip(data, times, rows):
    payload = gif.payload_of(np.frombuffer(data * times, np.uint8))
    found = gif.decode(gif.encode(payload, rows=rows))
    assert b"".join(f.shown()[..., 0].tobytes() for f in found) == payload.tobytes()
    assert [f.begin_ms for f in found] == [100 * i for i in range(len(found))]


def _plain_lzw(pixels, size, full=4096, rest=0):
    """A textbook coder, a sample at a time; a full table is kept for ``rest`` more codes before it is cleared."""
    clear, bits, table, width, free, word, kept = 1 << size, [], {}, size + 1, (1 << size) + 2, (), 0
    put = lambda code: bits.extend(code >> k & 1 for k in range(width))
    put(clear)
    name = lambda w: table[w] if len(w) > 1 else w[0]
    for p in pixels:
        if word and (*word, p) not in table:
            put(name(word))
            if free < full:
                table[(*word, p)] = free
                width += free == 1 << width and width < 12
                free += 1
            elif kept == rest:
                put(clear)
                table, width, free, kept = {}, size + 1, clear + 2, 0
            else:
                kept += 1
            word = (p,)
        else:
            word = (*word, p)
    if word:
        put(name(word))
        width += free == 1 << width and width < 12
    put(clear + 1)
    bits += [0] * (-len(bits) % 8)
    return np.packbits(np.array(bits, np.uint8), bitorder="little")


def test_streams_of_other_coders():
    rng = np.random.default_rng(0)
    cases = [(rng.integers(0, 256, 30_000), 8, 0), (rng.integers(0, 256, 30_000), 8, 5000), (np.zeros(70_000, int), 8, 0), (rng.integers(0, 3, 60_000), 2, 700), (rng.integers(0, 2, 9), 2, 0), (np.zeros(0, int), 3, 0)]
    streams = [(_plain_lzw(x.tolist(), size, rest=rest), size, len(x)) for x, size, rest in cases]
    for (x, _, _), got in zip(cases, gif.lzw_decode(streams), strict=True):
        assert (got == x).all()
    short, long_, wrong = gif.lzw_decode([(streams[0][0], 8, 100), (streams[4][0], 2, 20), (np.array([0, 0xFF, 0xFF, 0xFF], np.uint8), 8, 5)])
    assert (short == cases[0][0][:100]).all() and (long_[:9] == cases[4][0]).all() and not long_[9:].any() and isinstance(wrong, ValueError)


def test_streams_are_read_by_a_plain_reader():
    rng, text = np.random.default_rng(1), np.frombuffer(b"to be or not to be, that is the question. " * 400, np.uint8)
    frames = [text[:17], text, rng.integers(0, 256, 9000).astype(np.uint8), np.zeros(8000, np.uint8), text[:0]]
    for frame, stream in zip(frames, gif.lzw_encode(frames), strict=True):
        bits = np.unpackbits(stream, bitorder="little")
        at, width, table, before, out = 0, 9, [], None, []
        while True:
            code = int(bits[at : at + width] @ (1 << np.arange(width)))
            at += width
            if code == 256:
                width, table, before = 9, [bytes([i]) for i in range(256)] + [b"", b""], None
                continue
            if code == 257:
                break
            now = table[code] if code < len(table) else before + before[:1]
            if before is not None:
                table.append(before + now[:1])
            width = max(width, min(12, len(table).bit_length() if before is None else (len(table)).bit_length()))
            out.append(now)
            before = now
        assert b"".join(out) == frame.tobytes() and len(bits) - at < 8
    assert len(gif.lzw_encode([text])[0]) < len(text) / 3


def _image(left, top, w, h, pixels, disposal=0, hidden=None, interlace=False, delay=5, size=2):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (hidden is not None), delay, hidden or 0, 0)
    body = gif.lzw_encode([np.array(pixels, np.uint8)], size)[0].tobytes()
    return control + struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0x40 * interlace, size) + bytes([len(body)]) + body + b"\0"


def _gif(w, h, *images):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"".join(images) + b";"


def test_gif_disposal_transparency_interlace():
    red = [1] * 4
    shown = gif.decode(_gif(2, 2, _image(0, 0, 2, 2, red), _image(0, 0, 1, 1, [2], disposal=3), _image(1, 1, 1, 1, [3], disposal=2), _image(0, 0, 2, 1, [0, 2], hidden=0)))
    assert shown[1].canvas[0, 0, :3].tolist() == [0, 255, 0]
    assert shown[2].canvas[0, 0, :3].tolist() == [255, 0, 0] and shown[2].canvas[1, 1, :3].tolist() == [0, 0, 255]
    assert shown[3].canvas[1, 1].tolist() == [0, 0, 0, 0] and shown[3].canvas[0, :, :3].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert [f.begin_ms for f in shown] == [0, 50, 100, 150] and shown[0].histogram()[gif.BINS - 1] == 4
    rows = [k % 4 for k in (0, 4, 2, 6, 1, 3, 5, 7)]  # the order of an interlaced image of eight rows
    straight = gif.decode(_gif(1, 8, _image(0, 0, 1, 8, rows, interlace=True)))[0].canvas[:, 0, :3].tolist()
    assert straight == [[[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]][k % 4] for k in range(8)]
    with pytest.raises(ValueError, match="not a GIF"):
        gif.decode(b"PNG")


def test_media_columns(awkward, nothing, spark):
    from pyspark.sql import functions as F

    media = gif.to_media(awkward)
    rows = gif.digests(media).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, set()).add((r.text or "").encode())
    for r in rows:
        raw = next(t for t in texts[r.doc_id])
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    frames = gif.frames(media)
    assert frames.where("error is not null").count() == 0 and frames.where(F.aggregate("red", F.lit(0), lambda a, b: a + b) <= 0).count() == 0
    bad = spark.createDataFrame([(1, b"x"), (2, None)], "doc_id long, media binary")
    assert gif.frames(bad).where("error is not null and frame is null").count() == 2
    assert gif.digests(gif.to_media(nothing)).count() == 0


def _best(model, word):
    score = {model.pieces[i]: model.scores[i] for i in model.ids}
    best = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            v = score.get(word[s:e], model.unknown if e - s == 1 else None)
            if v is not None:
                best[e] = max(best[e], best[s] + v)
    return best[-1]


def test_viterbi_is_optimal_and_lossless():
    model = pieces.model_of(pieces.MODEL)
    rng = random.Random(4)
    for _ in range(150):
        word = "▁" + "".join(rng.choices("abcdeéthing漢😀", k=rng.randint(0, 14)))
        points = pieces.code_points(word)[None]
        piece, start = pieces.viterbi(model, points)
        at, total = len(word), 0.0
        while at:
            i = piece[0, at - 1]
            total += model.scores[i] if i >= 0 else model.unknown
            at = start[0, at - 1]
        assert total == pytest.approx(_best(model, word))
    texts = ["", "a", " ", "  a  b ", "▁x ▁", "\n\t", "😀 é", "\x00<0x41></s>", "門 水"] + ["".join(rng.choices("ab ▁\n漢é", k=rng.randint(0, 40))) for _ in range(200)]
    ids, counts = pieces.encode_texts(model, texts)
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert [pieces.decode_ids(model, ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] == texts


def test_pieces_on_awkward_rows(awkward, nothing):
    encoded = pieces.encode(awkward)
    assert sorted((r.text is not None, r.text) for r in pieces.decode(encoded).collect()) == sorted((r.text is not None, r.text) for r in awkward.collect())
    digests = {r.doc_id: r for r in pieces.digests(encoded).collect()}
    assert digests[15].n_pieces is None and digests[14].n_pieces == 0
    assert pieces.decode(pieces.encode(nothing)).count() == 0


def test_patterns_that_cancel_in_polynomials_get_their_own_ids():
    """The Thue-Morse word and its complement agree in every polynomial hash modulo a power of two."""
    from readloom.llm.common import buffers, range_hashes
    import pyarrow as pa

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "ab" * 9 + " " + "ba" * 9]
    ids, counts = token_store.word_bpe()(*buffers(pa.array(texts)))
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == _library(texts)
    data, offs = buffers(pa.array(texts[:2]))
    assert len(set(range_hashes(data, offs[:-1], offs[1:]).tolist())) == 2


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=70), st.integers(0, 20), st.integers(0, 20))
def test_range_hashes_know_bytes_only(data, before, after):
    from readloom.llm.common import range_hashes

    whole = np.frombuffer(b"q" * before + data + b"z" * after, np.uint8)
    alone = range_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
    inside = range_hashes(whole, np.array([before]), np.array([before + len(data)]))
    other = range_hashes(np.frombuffer(data + b"\0", np.uint8), np.array([0]), np.array([len(data) + 1]))
    assert alone == inside != other


def test_text_without_spaces_is_cut_where_no_piece_crosses():
    model = pieces.model_of(pieces.MODEL)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcxyzqé漢字門水ing", k=n)) for n in (40, 90, 300)] + ["水" * 50 + "the" * 30, "q" * 70]
    for t in texts:
        ids, _ = pieces.encode_texts(model, [t])
        whole = pieces.code_points("▁" + t)[None]
        again, _ = pieces._trace(model, whole, *pieces.viterbi(model, whole))
        assert ids.tolist() == again.tolist() and pieces.decode_ids(model, ids) == t
    import time

    began = time.perf_counter()
    ids, _ = pieces.encode_texts(model, ["".join(rng.choices("漢字門水火木金土日月", k=200_000))])
    assert time.perf_counter() - began < 5 and len(ids) >= 200_000


def test_sorted_keys_find_what_they_hold():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    rng.shuffle(keys)
    table = pieces.Keys(keys)
    ask = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    want = {int(k): i for i, k in enumerate(keys)}
    assert table.find(ask).tolist() == [want.get(int(k), -1) for k in ask]
    assert pieces.Keys(np.zeros(0, np.uint64)).find(ask[:3]).tolist() == [-1] * 3
