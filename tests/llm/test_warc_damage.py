"""The salvage reader on flipped bits, false starts and damaged gzip headers: what it gives was written, in linear time."""

import random
import time

import pytest

from quernstone.llm import warc


def six():
    return [warc.make_record(i, f"http://x/é{i}", f"payload {i} ".encode() * 9, 5 if i in (1, 3) else None, f"2024-0{i + 1}-01T00:00:00Z") for i in range(6)]


def told(found):
    return tuple(found[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "payload"))


@pytest.mark.parametrize("form", ["plain", "one member", "members"])
def test_flipped_bits_give_no_record_that_was_not_written(form):
    records = six()
    data = b"".join(records)
    data = warc.zipped(data) if form == "one member" else b"".join(map(warc.zipped, records)) if form == "members" else data
    wanted = {told(x) for x in warc.read_archive(data)}
    assert len(wanted) == 6
    rng = random.Random(form)
    recovered = []
    for _ in range(3000):
        at = rng.randrange(len(data))
        changed = data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :]
        found = {told(x) for x in warc.read_archive(changed) if x["gap"] is None}
        assert found <= wanted
        recovered.append(len(found))
    assert form == "one member" or min(recovered) >= 5
    assert sum(recovered) / len(recovered) > (1 if form == "one member" else 4.9)


@pytest.mark.parametrize("at, bit", [(0, 1), (1, 8), (2, 1), (3, 4), (3, 8), (3, 16), (3, 2)])
def test_damaged_gzip_headers_lose_nothing(at, bit):
    data = bytearray(warc.zipped(b"".join(six())))
    data[at] ^= bit
    assert [x["page_id"] for x in warc.read_archive(bytes(data)) if x["gap"] is None] == list(range(6))


@pytest.mark.parametrize(
    "unit",
    [
        b"\x1f\x8b\x08",
        b"\x1f\x8b\x08\x00",
        *(b"\x1f\x8b\x08" + bytes([flag]) + b"abcdefghij" * 6 for flag in (0, 1, 2, 4, 8, 16, 24, 31)),
        *(b"\x1f\x8b\x08" + bytes([flag]) + b"abcdefghij\0" * 6 for flag in (0, 4, 8, 16, 31)),
        b"WARC/1.1\r\n",
        b"WARC/1.1\r\nContent-Length: 9\r\n\r\n",
        warc.zipped(b"WARC/1.1\r\nnothing more" * 3)[:-9],
        warc.zipped(random.Random(1).randbytes(400)),
    ],
)
def test_false_starts_take_linear_time(unit):
    def seconds(size):
        data = (unit * (size // len(unit) + 1))[:size]
        began = time.process_time()
        assert all(x["gap"] for x in warc.read_archive(data))
        return time.process_time() - began

    short, long = (min(seconds(n) for _ in range(2)) for n in (200_000, 800_000))
    assert long < 6 * short + 0.3  # a square would be 16 times as much


def test_eight_megabytes_of_false_starts_are_read():
    assert [x["end"] for x in warc.read_archive(b"\x1f\x8b\x08\x08" * 2_000_000)] == [8_000_000]


def test_revisits_are_held_against_their_responses(spark):
    rows = [(1, "A", "response", None), (2, "A", "revisit", 1), (3, "B", "revisit", 1), (4, "C", "revisit", 9), (None, "D", "response", None)]
    table = spark.createDataFrame(rows, "page_id long, payload_digest string, record_type string, refers_to long")
    assert [r.page_id for r in warc.revisits_at_odds(table).collect()] == [3]


def test_archives_from_elsewhere_need_no_header_digest():
    record = (
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:12345678-1234-1234-1234-123456789012>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        b"WARC-Target-URI: http://x/\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    )
    for data in (record * 2, warc.zipped(record) * 2, warc.zipped(record * 2)):
        assert [(x["payload"], x["page_id"]) for x in warc.read_archive(data)] == [(b"body", None)] * 2
    assert [x["gap"] for x in warc.read_archive(record.replace(b"response", b"respxnse"))] == ["type"]
