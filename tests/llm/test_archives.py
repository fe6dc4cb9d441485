"""WARC archives, ORC token files and byte-pair encoding: exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm import bpe, orcids, warc
from carelake.llm.common import scratch_path

SPEC = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(SPEC)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts() -> list[str]:
    rnd = random.Random(1)
    out = ["", "  ", "Hello wörld <|endoftext|>'s 123 Σας ΑΣ", "a" * 3000, "日本語テキスト 😀👩‍👩‍👧 ½ ²", "don't I'LL we've x\x1cy\x1fz\x00 \x85 \xa0"]
    out += ["é é İstanbul ǅ ﬁ", "<|startoftext|><|startoftext|>x<|endoftext|", "aaaaaaaaaaaa bbbb abababab", " ́ a", "Ⅷ ٣٤ x²y", "ab " * 5000]
    out += ["".join(rnd.choice("abcdeéxyz .,'1!İΣ́​中\n") for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x370, 0x1FFF), rnd.randint(0x2000, 0xD7FF)])) for _ in range(20)) for _ in range(200)]
    return out


def test_encoding_is_the_library_s(spark, library):
    texts = odd_texts()
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7), (5, None, 7), (0, texts[0], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    got = bpe.unpack_ids(bpe.encode_decode(df, bpe.read_spec(spark, SPEC))).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r["doc_id"]), r["token_ids"], r["decoded"]) for r in got) == sorted(want)
    assert bpe.encode_decode(df.where("doc_id < 0"), bpe.read_spec(spark, SPEC)).count() == 0


def test_every_token_pair_test_agrees_with_merging(library):
    vocabulary = bpe.Vocabulary(open(SPEC, encoding="utf-8").read())
    rnd = random.Random(4)
    plain = [t for t, i in vocabulary.ids.items() if t.isascii() and t.isalpha() and t.islower() and vocabulary._whole(i, t)]
    for _ in range(3000):
        word = "".join(rnd.choices(plain, k=rnd.randint(1, 4)))
        assert vocabulary.word(word) == library.encode(word, add_special_tokens=False).ids


def test_little_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    coder = bpe.Coder(open(SPEC, encoding="utf-8").read())
    for text in odd_texts()[:60]:
        assert list(memoryview(coder.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ways", [0, 5, 200_000])
def test_the_automaton_names_all_tokens_that_end_at_a_place(monkeypatch, ways):
    monkeypatch.setattr(bpe, "WAYS", ways)
    keys = {k: i for i, k in enumerate(["a", "b", "ab", "ba", "bab", "abba", "aab", "bbab", "cab"])}
    state = bpe.automaton(keys)
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcx", k=2000))
    for end, symbol in enumerate(text, 1):
        state = state[symbol]
        assert list(state.ending) == [keys[text[b:end]] for b in range(max(0, end - 4), end) if text[b:end] in keys]


def test_only_prefixes_that_the_end_leads_to_are_tested(library):
    vocabulary = bpe.Vocabulary(open(SPEC, encoding="utf-8").read())
    assert vocabulary.word("information") == library.encode("information", add_special_tokens=False).ids
    assert len(vocabulary.known) <= 1  # one token, or two: no pair of its shorter prefixes was tried


def test_a_worker_keeps_its_coder_from_task_to_task():
    content = open(SPEC, encoding="utf-8").read()
    kept = bpe._coder(content)
    kept.encode("remembered words")
    assert bpe._coder(content) is kept and "remembered" in kept.new


@pytest.mark.parametrize("files", [1, 3])
def test_orc_files_give_back_every_id(spark, library, files):
    texts = [*odd_texts()[:40], "many words " * 4000]
    rows = [(i * 3 - 20, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (1, "again", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = scratch_path(spark, "orc-test")
    orcids.write(df, bpe.read_spec(spark, SPEC), path, files)
    coded = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    assert sorted((r["doc_id"], r["ids"]) for r in orcids.read(spark, path).collect()) == sorted((i, coded[i, t]) for i, t, _ in rows)
    want, start = [], 0
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda x: x[0]):
        ids = coded[i, t]
        want.append((i, start, len(ids), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids))))
        start += len(ids)
    got = orcids.placed(spark, path)
    kept = [r for r in got.orderBy("start").collect()]
    assert [tuple(r) for r in kept if r["doc_id"] != 1] == [w for w in want if w[0] != 1]
    assert sorted(r["n_tokens"] for r in kept) == sorted(w[2] for w in want)
    assert orcids.read(spark, path).where("doc_id = 500").count() == 1


def test_orc_of_nothing_and_without_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (4, "c")], "doc_id long, text string")
    path, empty = scratch_path(spark, "orc-test"), scratch_path(spark, "orc-test")
    orcids.write(df, bpe.read_spec(spark, SPEC), path, 2)
    got = [tuple(r)[:3] for r in orcids.placed(spark, path).orderBy("start").collect()]
    assert [(i, s) for i, s, _ in got][0] == (None, 0) and got[-1][0] == 4 and got[-1][1] == 4
    orcids.write(df.where("doc_id < 0"), bpe.read_spec(spark, SPEC), empty, 2)
    assert orcids.placed(spark, empty).count() == 0


def pages():
    rnd = random.Random(2)
    rows = [(i, f"http://x/{i}", f"<p>{'é' * rnd.randint(0, 200)}{rnd.random()}</p>" * rnd.randint(0, 40)) for i in range(120)]
    hot = "<html>" + "same " * 50 + "</html>"
    rows += [(i, None, hot) for i in range(130, 200)] + [(200, "u\r\nv", "short"), (201, "u", "short"), (202, None, None), (203, "u", "")]
    rows += [(None, "u", hot), (None, None, None), (130, "again", hot), (140, "again", hot), (204, "u", "x" * 2_000_000), (205, "u", "a\r\n\r\nb" * 30)]
    return rows


@pytest.mark.parametrize("files", [1, 5])
def test_archives_give_back_every_page(spark, files):
    rows = pages()
    df = spark.createDataFrame([(*r, "size", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    path = scratch_path(spark, "warc-test")
    warc.write(df, path, files)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and not [r["error"] for r in got if r["error"]]
    first: dict = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want, seen = [], set()
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(html) if i is not None else None
        revisit = refers is not None and (refers != i or i in seen)
        if refers == i:
            seen.add(i)
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), *[r[n] for n in ("payload_bytes", "payload_digest", "record_type", "refers_to")])) for r in got)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    warc.write(df.where("page_id < 0"), empty := scratch_path(spark, "warc-test"), 2)
    assert warc.read(spark, empty).count() == 0


def archive(records, dictionary=None):
    packer = zstandard.ZstdCompressor(dict_data=dictionary) if dictionary else zstandard.ZstdCompressor()
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(packer.compress(r) for r in records)


def test_reader_reports_what_is_wrong():
    good = [warc.record(i, "u", b"payload %d " % i * 20, hashlib.sha256(b"payload %d " % i * 20).hexdigest(), len(b"payload %d " % i * 20), None, 0) for i in range(5)]
    plain = list(warc.records_of(archive(good)))
    assert [f["page_id"] for _, f, _ in plain] == [0, 1, 2, 3, 4]
    raw = zstandard.ZstdCompressionDict(b"payload " * 100, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert [e for _, _, e in warc.records_of(archive(good, raw))] == [None] * 5
    broken = [good[0][:-1], good[1].replace(b"payload 1", b"payload 9"), good[2].replace(b"WARC-Date", b"WARC-Dat"), b"no record", good[4]]
    errors = [e for _, _, e in warc.records_of(archive(broken))]
    assert errors[:4] == ["length of block", "digest of payload", "no WARC-Date", "no version line"] and errors[4] is None
    whole = archive(good)
    cut = list(warc.records_of(whole[:-9]))
    assert len(cut) == 5 and cut[-1][2].startswith("archive:") and [e for _, _, e in cut[:4]] == [None] * 4
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"junk"))[0][2].startswith("archive:")


def test_frames_end_where_the_library_says():
    for size in (0, 1, 200, 300_000):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            body = random.Random(size).randbytes(size // 2) + b"a" * (size - size // 2)
            frame = zstandard.ZstdCompressor(**options).compress(body)
            assert warc.frame_end(memoryview(frame + b"rest of it"), 0) == len(frame)


def test_spark_keeps_bytes_that_are_no_text(spark):
    frame = bytes(range(256))
    path = scratch_path(spark, "raw")
    spark.createDataFrame([(frame,)], "b binary").select(F.col("b").cast("string")).coalesce(1).write.option("lineSep", warc.SEPARATOR).text(path)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    assert b"".join(bytes(r["content"]) for r in read) == frame + warc.SEPARATOR.encode()
