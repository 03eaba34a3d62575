import os

import pytest

from recordaudit.llm import flac, media, warc

PAYLOADS = [b" " * 192, bytes(range(192)), os.urandom(192 * 5), b"\xff" * 192, b"\x00\xff" * 96 * 300, media.payload("a" * 100_000), media.payload(None), media.payload("lorem ipsum dolor " * 999)]


def test_flac_round_trip():
    streams = flac.encode(PAYLOADS)
    assert [s.pcm for s in flac.decode(streams)] == PAYLOADS
    assert [flac.encode([p])[0] for p in PAYLOADS] == streams  # a stream does not depend on its neighbours
    assert all(s[:4] == b"fLaC" for s in streams)


def test_flac_kinds_of_subframes():
    x = bytes(128 + round(60 * (i / 40 % 2 - 1)) for i in range(192 * 4))
    kinds = {flac.encode([p])[0][42 + 6] >> 1 for p in (b"\x07" * 192, os.urandom(192), x[:192])}
    assert {0, 1} < kinds and any(k >= 8 for k in kinds)


def test_flac_frame_numbers():
    assert [flac._number(n).hex() for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == ["00", "7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080"]
    long = b"ab" * 96 * 3000
    assert flac.decode(flac.encode([long]))[0].pcm == long


@pytest.mark.parametrize("place", [46, 60, 120])
def test_flac_damage_is_found(place):
    stream = bytearray(flac.encode([PAYLOADS[-1]])[0])
    stream[place] ^= 16
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_pcm_blocks_can_be_sought(docs):
    texts = {1: "some words " * 700, 2: None}
    coded = media.encode_media(docs(list(texts.items())))
    stored = {r["doc_id"]: r["media"] for r in coded.collect()}
    for r in media.pcm_blocks(coded, 8).collect():
        whole = media.payload(texts[r["doc_id"]])
        assert bytes(r["pcm"]) == whole[r["sample_offset"]:r["sample_offset"] + r["n_samples"]]
        assert bytes(stored[r["doc_id"]])[r["byte_offset"]:][:2] == b"\xff\xf8"


def test_archive_gives_back_the_records(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "http://c", "é" * 9), (5, "http://d", "same")], "page_id long, url string, html string")
    kept = warc.write_archive(pages)
    assert spark.read.parquet(kept.payloads).count() == 3
    records = {r["page_id"]: warc.record_bytes(r["header"], r["packed"]) for r in warc.records(spark, kept).collect()}
    assert records[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[5].endswith(b"\r\n\r\nsame\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:5:" in records[1] and b"WARC-Target-URI: http://b%0D%0AX: y\r\n" in records[2]
    read = {r["page_id"]: r for r in warc.read_archive(spark, kept).collect()}
    assert [(read[i]["record_type"], read[i]["refers_to"]) for i in range(1, 6)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None)]
    assert bytes(read[4]["payload"]).decode() == "é" * 9
    assert read[3]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.digest_pages(pages, least_bytes=3).collect()}
    assert got == {1: ("response", None, 2), 2: ("response", None, 2), 3: ("revisit", 4, 3), 4: ("response", None, 3)}


def test_wrong_digest_is_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError):
        warc.parse_record(record)
